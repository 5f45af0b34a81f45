"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors are scaled to length one, where the largest cosine is the least
Euclidean distance, and projected on a few Gaussian (2-stable) directions: the
squared projected distance of two vectors is their squared distance times a
chi-square variable.  The projected points are held in blocks by a kd-tree of
two levels: planes fitted on a bounded sample, and in each of their leaves as
many cuts, at quantiles over all its points, as its number of points wants;
every block has a kd-tree of its own.  A query takes projected neighbours in order of
distance and verifies each with the original vectors until the chi-square test
says that a nearer one is still to come with a probability of under
``1 - CONFIDENCE``.  It does so first in its home block, then in the blocks
that the test can't rule out from there.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import chi2_quantile
from millrace.sources.storage import materialize

#: Directions, confidence of the stopping test, rows that the planes are fitted on.
DIRECTIONS, CONFIDENCE, SAMPLE = 8, 0.99, 20_000
#: Rows wanted in a block, leaves of the tree over all blocks at most, points of a leaf of a block's tree.
BLOCK, LEAVES, POINTS = 4096, 1024, 256
#: Cuts of a leaf into slabs, so that a query opens the slabs in its reach and not the whole leaf.
SLABS = 64
#: Lengths of vectors, the most frequent ones, that have planes; vectors of others are one leaf for each length.
LENGTHS = 64


def directions(dim: int, m: int = DIRECTIONS, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one, scaled by their largest part first so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest part near one: exact, and no square under- or overflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(-1, keepdims=True))[1])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``, on the original vectors in double precision."""
    a, b = _scaled(a), _scaled(b)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


class KdTree:
    """Points in leaves of ``POINTS``, each leaf with its bounding box."""

    def __init__(self, points: np.ndarray) -> None:
        self.order = np.arange(len(points))
        cuts = [(0, len(points))]
        leaves = []
        while cuts:
            a, b = cuts.pop()
            if b - a <= POINTS:
                leaves.append((a, b))
                continue
            part = points[self.order[a:b]]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, axis], mid)]
            cuts += [(a, a + mid), (a + mid, b)]
        self.leaves = sorted(leaves)
        self.low = np.array([points[self.order[a:b]].min(0) for a, b in self.leaves])
        self.high = np.array([points[self.order[a:b]].max(0) for a, b in self.leaves])

    def boxes(self, at: np.ndarray) -> np.ndarray:
        """Squared distance of a point to every leaf's box."""
        gap = np.maximum(0, np.maximum(self.low - at, at - self.high))
        return (gap * gap).sum(1)


def plane_tree(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """A complete tree of median planes over the sample, as (axis, place) in heap order."""
    planes: list[tuple[int, float]] = [(0, 0.0)] * (leaves - 1)
    parts = {0: points}
    for node in range(leaves - 1):
        part = parts.pop(node)
        if len(part):
            axis = int(np.argmax(part.max(0) - part.min(0)))
            place = float(np.median(part[:, axis]))
            planes[node] = (axis, place)
        axis, place = planes[node]
        right = part[:, axis] > place
        parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]
    return planes


def leaf_of(points: np.ndarray, planes: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    if not planes:
        return node
    axes, places = np.array([a for a, _ in planes]), np.array([p for _, p in planes])
    for _ in range(int(math.log2(len(planes) + 1))):
        node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] > places[node])
    return node - len(planes)


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vec)`` in double precision without null, empty, zero or non-finite vectors."""
    vec = F.col("vec")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    return table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where(vec.isNotNull() & F.col("id").isNotNull()).where(sound)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def search_block(ids: list, vectors: np.ndarray, queries: np.ndarray, k: int, bounds: np.ndarray, m: int = DIRECTIONS, confidence: float = CONFIDENCE) -> list[list[tuple[float, int]]]:
    """For each query its nearest ``(cosine, row)`` in this block, at most the ``k`` that can count.

    ``bounds`` holds a squared distance for each query beyond which nothing
    matters to it.  Rows stand for ``len(ids[row])`` equal vectors.
    """
    limit = chi2_quantile(confidence, m)
    project = directions(vectors.shape[1], m)
    mine, theirs = unit(vectors), unit(queries)
    points, starts = mine @ project, theirs @ project
    tree = KdTree(points)
    weight = np.array([len(x) for x in ids])
    out = []
    for q in range(len(queries)):
        near = tree.boxes(starts[q])
        best: list[tuple[float, int]] = []
        reach = bounds[q]
        for leaf in np.argsort(near, kind="stable"):
            # Everything still to come lies at least this far off in projection.
            if near[leaf] > limit * reach + 1e-9:
                break
            a, b = tree.leaves[leaf]
            rows = tree.order[a:b]
            gap = points[rows] - starts[q]
            rows = rows[(gap * gap).sum(1) <= limit * reach + 1e-9]
            if not len(rows):
                continue
            far = ((mine[rows] - theirs[q]) ** 2).sum(1)
            best += zip(far.tolist(), rows.tolist())
            best.sort()
            held = 0
            for n, (d, row) in enumerate(best):
                held += weight[row]
                if held >= k:
                    # Rounding must not part equal distances, so near ties stay.
                    edge = d + 1e-9
                    best = [x for x in best if x[0] <= edge]
                    reach = min(reach, d)
                    break
        scores = cosine(np.broadcast_to(queries[q], (len(best), queries.shape[1])), vectors[[r for _, r in best]]) if best else []
        out.append([(float(s), r) for s, (_, r) in zip(scores, best)])
    return out


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", m: int = DIRECTIONS, confidence: float = CONFIDENCE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows of ``table`` by cosine for each row of ``queries``.

    A row of ``table`` with the query's own id is no candidate.  Ranks count
    from 1, ties go to the smaller id.  Vectors that are null, empty, zero or
    hold null or non-finite parts take no part, neither do rows without an id;
    a row of another length than most is compared with those of its length
    only.  Equal vectors are one point that knows its ``k + 1`` smallest ids,
    so copies in any number are searched once.  Repeated query rows count
    once; other columns are ignored; without rows or queries there is no
    result.  The planes are fitted on at most ``SAMPLE`` vectors, the cuts on
    all.
    """
    spark = table.sparkSession
    rows = materialize(valid_vectors(table, id_col, vector_col), "vectors")
    asked = materialize(valid_vectors(queries, id_col, vector_col).dropDuplicates(["id"]), "queries")
    by_vector = Window.partitionBy("vec").orderBy("id")
    smallest = rows.distinct().withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1)
    # A group is at most k + 1 rows here.
    points = materialize(smallest.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    wanted = materialize(asked.select("vec").distinct().withColumn("q", F.monotonically_increasing_id()), "wanted")

    total = points.count()
    leaves = 1 << max(0, min(int(math.log2(LEAVES)), math.ceil(math.log2(max(1, total) / BLOCK))))
    dims = [r["d"] for r in points.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(LENGTHS).collect()]
    share = min(1.0, 2 * SAMPLE / max(1, total))
    sample = points.select("vec").sample(share, 11).limit(SAMPLE).toPandas()["vec"].tolist() if leaves > 1 else []
    plans = {}
    for d in dims:
        own = np.array([x for x in sample if len(x) == d], float).reshape(-1, d)
        plans[d] = plane_tree(unit(own) @ directions(d, m) if len(own) else np.zeros((0, m)), leaves)

    def locate(batches):
        for batch in batches:
            vecs = batch.column(0).to_pylist()
            found = np.zeros((len(vecs), m))
            leaf = np.zeros(len(vecs), np.int64)
            for d in {len(v) for v in vecs}:
                at = [i for i, v in enumerate(vecs) if len(v) == d]
                p = unit(np.array([vecs[i] for i in at], float)) @ directions(d, m)
                found[at] = p
                leaf[at] = leaf_of(p, plans[d]) if d in plans else 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaf), pa.array(found.tolist(), pa.list_(pa.float64()))], [*batch.schema.names, "leaf", "p"]
            )

    kind = lambda df: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", leaf bigint, p array<double>"
    placed = points.mapInArrow(locate, kind(points))
    placed = materialize(placed.withColumn("d", F.size("vec")), "placed")
    # Leaves by their number of rows: one with many is cut into slabs along its longest side, at quantiles of all its points.
    spans = [F.struct(F.min(F.element_at("p", i + 1)).alias("low"), F.max(F.element_at("p", i + 1)).alias("high")) for i in range(m)]
    side = F.array(*((F.max(F.element_at("p", i + 1)) - F.min(F.element_at("p", i + 1))) for i in range(m)))
    leaf_sizes = placed.groupBy("d", "leaf").agg(F.count(F.lit(1)).alias("n"), F.array(*spans).alias("box"), side.alias("side"))
    leaf_sizes = leaf_sizes.select("d", "leaf", "box", F.ceil(F.col("n") / (2 * BLOCK)).cast("int").alias("blocks"), F.array_position("side", F.array_max("side")).cast("int").alias("axis"))
    # At most LEAVES rows for each length of vectors.
    leaf_sizes = materialize(leaf_sizes, "leaves")
    tree = F.broadcast(leaf_sizes)
    within = placed.join(F.broadcast(leaf_sizes.where("blocks > 1").select("d", "leaf", "axis")), ["d", "leaf"])
    shares = F.percentile_approx(F.element_at("p", F.col("axis")), F.lit([k / SLABS for k in range(1, SLABS)]), 10_000)
    cuts = materialize(within.groupBy("d", "leaf").agg(shares.alias("shares")), "cuts")
    tree = F.broadcast(leaf_sizes.join(cuts, ["d", "leaf"], "left"))
    # The block of a point: how many of its leaf's cuts it is beyond, as many as blocks are wanted up to SLABS, and a hash of it in leaves that want more.
    beyond = F.size(F.filter("shares", lambda c: c < F.element_at("p", F.col("axis"))))
    slab = F.when(F.col("blocks") > 1, F.floor(beyond * F.least("blocks", F.lit(SLABS)) / SLABS)).otherwise(F.lit(0)).cast("int")
    parts = F.ceil(F.col("blocks") / SLABS).cast("int")
    blocks = placed.join(tree, ["d", "leaf"]).select("d", "leaf", slab.alias("slab"), F.pmod(F.xxhash64("vec"), parts).cast("int").alias("block"), "vec", "ids", "p")
    blocks = materialize(blocks, "blocks")
    # Boxes of the slabs, SLABS for each leaf at most, with the number of their blocks.
    boxes = blocks.groupBy("d", "leaf", "slab").agg(F.array(*spans).alias("box"), (F.max("block") + 1).alias("parts"))
    boxes = materialize(boxes, "boxes")
    homes = wanted.mapInArrow(lambda it: locate(it), kind(wanted)).withColumn("d", F.size("vec"))
    homes = materialize(homes.join(tree, ["d", "leaf"], "left").select("q", "vec", "p", "d", "leaf", slab.alias("slab")), "homes")

    def look(key, data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        columns = ["q", "vec_id", "score"]
        if not len(data) or not len(ask):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        ids = [list(x) for x in data["ids"]]
        found = search_block(ids, _matrix(data["vec"]), _matrix(ask["vec"]), k + 1, ask["reach"].to_numpy(float), m, confidence)
        out = []
        for q, near in zip(ask["q"].tolist(), found):
            every = sorted(((-s, i) for s, row in near for i in ids[row]))[: k + 1]
            out += [(q, int(i), -s) for s, i in every]
        return pd.DataFrame(out, columns=columns).astype({"q": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["d", "leaf", "slab", "block"]
    result = "q bigint, vec_id bigint, score double"
    data = blocks.groupBy(*keys)
    deal = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block")
    slabs = F.broadcast(boxes)
    first = homes.join(slabs.select("d", "leaf", "slab", "parts"), ["d", "leaf", "slab"]).select("d", "leaf", "slab", deal, "q", "vec", F.lit(5.0).alias("reach"))
    home = materialize(data.cogroup(first.groupBy(*keys)).applyInPandas(look, result), "home")
    limit = chi2_quantile(confidence, m)
    top = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    bound = home.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
    reach = F.when(F.col("n") > k, F.greatest(F.lit(0.0), 2 - 2 * F.col("worst")) + 1e-9).otherwise(F.lit(5.0))
    known = homes.join(bound, "q", "left").select("q", "vec", "p", F.struct("leaf", "slab").alias("home"), "d", reach.alias("reach"))
    # A query meets the boxes of the tree, LEAVES times SLABS at most, not the rows in them.
    gap = F.aggregate(
        F.zip_with("p", "box", lambda x, s: F.greatest(F.lit(0.0), s["low"] - x, x - s["high"])), F.lit(0.0), lambda total, g: total + g * g
    )
    away = known.join(slabs, "d").where((F.struct("leaf", "slab") != F.col("home")) & (gap <= limit * F.col("reach") + 1e-9))
    others = away.select("d", "leaf", "slab", deal, "q", "vec", "reach")
    more = data.cogroup(others.groupBy(*keys)).applyInPandas(look, result)
    best = home.unionByName(materialize(more, "more")).withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).drop("r")
    # Back from distinct vectors to the queries that have them, without each one's own row.
    answered = asked.join(wanted, "vec").select(F.col("id").alias("query_id"), "q").join(best, "q").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answered.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
