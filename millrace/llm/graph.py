"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.storage import discard, materialize

#: Copies of a node's least neighbour, each of which meets a share of the node's edges.
SALTS = 4


def _star(both: DataFrame, larger: bool) -> DataFrame:
    """Hang the larger (or the not larger) neighbours of a node on its least neighbour.

    The least neighbour is a partial aggregate, so a hub of any degree costs
    each map task one row; in the join that follows a hub's edges are dealt
    over ``SALTS`` tasks.
    """
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hung = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "salt"]).drop("salt")
    if larger:
        hung = hung.where("v > u")
    else:
        hung = hung.where("v <= u")
    return hung


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both, True).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hung = _star(down, False)
    moved = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    heads = hung.where("u <> m").select("u", F.col("m").alias("v"))
    return moved.unionByName(heads).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("bit_xor(xxhash64(u, v))").alias("x"),
        F.expr("bit_xor(xxhash64(v, u))").alias("y"),
    ).first()
    return row["n"], row["x"], row["y"]


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Return ``(node, root)`` for every node of a non-trivial component.

    ``root`` is the least node of the component and has a row of its own.
    Each round is written to the shared folder; the rounds are logarithmic in
    the longest path.  Self loops and repeated edges are ignored, an edge with
    a null end too; without an edge there is no row.  The result is
    materialized.
    """
    now = materialize(
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    while mark[0]:
        following = materialize(_small_star(_large_star(now)), "edges")
        discard(now)
        before, now, mark = mark, following, _mark(following)
        if mark == before:
            break
    members = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = materialize(members.unionByName(members.select(F.col("root").alias("node"), "root").distinct()), "components")
    discard(now)
    return out
