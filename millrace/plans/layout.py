"""Shards, blocks and runs: where each write of a log lies, and what a compaction makes of it.

Within a shard the writes fill blocks of ``block_rows`` in the order of
``seq``; the last block of a shard stays open until it is full or the log is
drained.  Block numbers follow from positions, so they are the same however
the log was read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.order import positioned
from millrace.operators.resolve import compacted, newest

#: Bytes that a record is taken for when a block's size is given in bytes.
RECORD_BYTES = 116


def block_rows(size_bytes: int = 786_432) -> int:
    return max(1, size_bytes // RECORD_BYTES)


def shard_count(wanted: int = 16) -> int:
    """The next power of two; at least one."""
    return 1 << (max(1, wanted) - 1).bit_length()


def blocks(log: DataFrame, shard: Column, rows: int) -> DataFrame:
    """The log with ``shard`` and ``block``, both counted from 0.  Select what is needed first: all columns are sorted along."""
    placed = positioned(log.withColumn("shard", shard), ["seq"], ["shard"], "__place")
    out = placed.withColumn("block", F.floor((F.col("__place") - 1) / rows).cast("bigint")).drop("__place")
    out._millrace_path = placed._millrace_path
    return out


def shard_sizes(log: DataFrame, shard: Column) -> DataFrame:
    return log.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("records"))


def states(log: DataFrame, shard: Column, rows: int, drained: bool = False) -> DataFrame:
    """One row of counters: the writes in open blocks, and the blocks and writes that are sealed or sorted.

    Undrained, full blocks wait sealed to be sorted; drained, every block,
    open ones too, has become a sorted run.  Blocks fill in order, so how many
    there are follows from the shards' numbers of writes alone.
    """
    n = F.col("records")
    full, open_rows = F.floor(n / rows), n % rows
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    none = F.lit(0).cast("bigint")
    return shard_sizes(log, shard).agg(
        (none if drained else total(open_rows)).alias("active_records"),
        (none if drained else total(full)).alias("sealed_blocks"),
        (none if drained else total(full * rows)).alias("sealed_records"),
        (total(full + (open_rows > 0).cast("int")) if drained else none).alias("sorted_blocks"),
        (total(n) if drained else none).alias("sorted_records"),
    )


def backlog(log: DataFrame, shard: Column, rows: int, at_most: int) -> DataFrame:
    """One row: sealed blocks, those over the limit, and whether a writer has to wait."""
    sealed = F.coalesce(F.sum(F.floor(F.col("records") / rows)), F.lit(0)).cast("bigint")
    counted = shard_sizes(log, shard).agg(sealed.alias("pending"))
    return counted.select("pending", F.greatest(F.col("pending") - at_most, F.lit(0)).cast("bigint").alias("excess"), (F.col("pending") > at_most).alias("blocked"))


def zone_map(blocked: DataFrame) -> DataFrame:
    """Least and greatest key and the number of writes of every block."""
    return blocked.groupBy("shard", "block").agg(F.min("k").alias("min_key"), F.max("k").alias("max_key"), F.count(F.lit(1)).alias("rows"))


def sparse_index(log: DataFrame, shard: Column, every: int = 16) -> DataFrame:
    """``(shard, position, k)``: every ``every``-th write of a shard in key order, from the first."""
    placed = positioned(log.select("k", "seq", shard.alias("shard")), ["k", "seq"], ["shard"], "__place")
    return placed.where((F.col("__place") - 1) % every == 0).select("shard", (F.col("__place") - 1).alias("position"), "k")


def compact_shards(log: DataFrame, shard: Column) -> DataFrame:
    """Per shard: writes before a full compaction, keys, and rows after it."""
    before = shard_sizes(log, shard)
    after = newest(log).groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("op") == "P").alias("live"))
    return before.join(after, "shard")


def compact_run(log: DataFrame, whole_history: bool) -> DataFrame:
    """What a compaction writes; a partial one keeps its tombstones, which still hide older runs."""
    return compacted(log, keep_tombstones=not whole_history)
