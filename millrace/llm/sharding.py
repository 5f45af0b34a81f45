"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns a fixed number of points on a ring of 2**62 places; a key
belongs to the first point clockwise of its hash.  A shard takes at most its
bound; keys that overflow a full shard continue clockwise to the next point
whose shard has room.  The bounds add up to the number of rows, so every shard
ends exactly full and counts differ by one at most, whatever the keys are.

Only the rows' counts per arc between two points are looked at by the driver:
they are as many as there are points.  Who moves on is decided by the keys'
order in the arc, so a small change of the input moves few rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.storage import materialize


RING_BITS, STRETCH_BITS = 62, 12
RING, STRETCHES = 1 << RING_BITS, 1 << STRETCH_BITS
#: Points of a shard; parts that the rows of an arc are numbered in.
POINTS, PARTS = 64, 8
#: Repeated rows that are written out together.
RUN = 4096


def ring(shards: int, points: int = POINTS) -> list[tuple[int, int]]:
    """``(place, shard)`` of all points, clockwise.  Another shard adds points and moves none."""
    places = {}
    for shard in range(shards):
        for k in range(points):
            place = int.from_bytes(hashlib.blake2b(f"{shard}/{k}".encode(), digest_size=8).digest(), "big") % RING
            places.setdefault(place, shard)
    return sorted(places.items())


def bounds(rows: int, shards: int) -> list[int]:
    """The most rows that each shard takes; they add up to ``rows``."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def flow(counts: list[int], owners: list[int], limits: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the keys of each arc go: ``(arc, first, end, shard, slot of the first)``.

    ``counts``: keys by arc; ``owners``: the shard at each arc's end.  First
    every arc's keys go to its own shard as far as there is room, in ring
    order; then what overflowed moves clockwise, nearest overflow first, until
    all have a place.
    """
    used = [0] * len(limits)
    pieces, waiting = [], []
    for arc, n in enumerate(counts):
        shard = owners[arc]
        take = min(n, limits[shard] - used[shard])
        if take:
            pieces.append((arc, 0, take, shard, used[shard]))
            used[shard] += take
        if n > take:
            waiting.append([arc, take, n])
    for step in range(1, len(owners)):
        still = []
        for arc, first, end in waiting:
            shard = owners[(arc + step) % len(owners)]
            take = min(end - first, limits[shard] - used[shard])
            if take:
                pieces.append((arc, first, first + take, shard, used[shard]))
                used[shard] += take
            if first + take < end:
                still.append([arc, first + take, end])
        waiting = still
        if not waiting:
            break
    return pieces


def arc_of(place: int, places: list[int]) -> int:
    return bisect_left(places, place) % len(places)


def _stretches(places: list[int]) -> list[tuple[int, int, int, int]]:
    """``(stretch, low, high, arc)``: the arcs cut at multiples of the stretch, so that a place finds its arc by an equi-join."""
    width = RING // STRETCHES
    cuts = sorted({*(k * width for k in range(STRETCHES)), *(p + 1 for p in places if p + 1 < RING), RING})
    return [(low // width, low, high, arc_of(low, places)) for low, high in zip(cuts, cuts[1:])]


def shard_rows(docs: DataFrame, shards: int = 40, points: int = POINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, size, text_crc32, shard, slot)`` for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes (none if null) plus 16, ``text_crc32``
    that of an empty text if null, ``slot`` counts from 0 without a gap in a
    shard.  A key is the hash of the id and of the text's checksum, so rows
    that share an id (or have none) spread over the ring; repeated rows have
    one place and are numbered in any order.  Other columns are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    points_of = ring(shards, points)
    places, owners = [p for p, _ in points_of], [s for _, s in points_of]
    # Bounded by the ring, as are the two tables below; so broadcasts of them are.
    arcs = F.broadcast(spark.createDataFrame(_stretches(places), "stretch bigint, low bigint, high bigint, arc int"))
    keyed = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("place", F.shiftrightunsigned(F.xxhash64("id", "text_crc32"), 2))
    met = keyed.withColumn("stretch", F.shiftrightunsigned("place", RING_BITS - STRETCH_BITS))
    rows = materialize(
        met.join(arcs, (met["stretch"] == arcs["stretch"]) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))).select(
            "id", "size", "text_crc32", "place", "arc", F.pmod("place", F.lit(PARTS)).cast("int").alias("part")
        ),
        "ring",
    )
    counted = {(r["arc"], r["part"]): r["n"] for r in rows.groupBy("arc", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, counts = [], []
    for arc in range(len(places)):
        total = 0
        for part in range(PARTS):
            starts.append((arc, part, total))
            total += counted.get((arc, part), 0)
        counts.append(total)
    pieces = flow(counts, owners, bounds(sum(counts), shards))
    offsets = F.broadcast(spark.createDataFrame(starts, "arc int, part int, before bigint"))
    routes = F.broadcast(spark.createDataFrame(pieces, "arc int, first bigint, end bigint, shard int, slot_first bigint"))
    within = Window.partitionBy("arc", "part").orderBy("place", "id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    same = rows.groupBy("arc", "part", "place", "id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("n"))
    first = F.coalesce(F.sum("n").over(within), F.lit(0)) + F.col("before")
    # Rows that are alike come back from their number, in stretches of bounded length.
    counted_rows = same.join(offsets, ["arc", "part"]).withColumn("k", first).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(RUN))))
    ranked = counted_rows.withColumn("k", F.explode(F.sequence(F.col("k") + F.col("at"), F.col("k") + F.least(F.col("at") + RUN, F.col("n")) - 1)))
    return ranked.join(routes, (ranked["arc"] == routes["arc"]) & (F.col("k") >= F.col("first")) & (F.col("k") < F.col("end"))).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("slot_first") + F.col("k") - F.col("first")).alias("slot")
    )
