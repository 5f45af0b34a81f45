"""Last write wins: the newest version of each key, lookups and scans over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.order import positioned
from millrace.sources.log import COLUMNS, DELETE, PUT


def newest(log: DataFrame) -> DataFrame:
    """The newest write of each key, deletes included.

    ``row_number() = 1`` lets Spark keep one row for each key and task before
    the exchange, so a key with any number of versions costs little, and
    carries wide values without a join.  Filters on ``k`` reach the scan.
    """
    latest = Window.partitionBy("k").orderBy(F.desc("seq"))
    return log.withColumn("__r", F.row_number().over(latest)).where(F.col("__r") == 1).drop("__r")


def live(log: DataFrame) -> DataFrame:
    """``(k, seq, v)`` of the keys whose newest write is a put; deletes are dropped after that choice, never before."""
    return newest(log).where(F.col("op") == PUT).select("k", "seq", "v")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The log as it was after the write ``seq``: a snapshot of all shards at once."""
    return log.where(F.col("seq") <= seq)


def get(log: DataFrame, key: Column) -> DataFrame:
    """``(k, v)`` of one key, or no row if it is absent or deleted."""
    return live(log.where(F.col("k") == key)).select("k", "v")


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """``(pos, k, found, v)`` for every row ``(pos, k)`` of ``keys``, repeated keys included.

    The log is first cut to the keys asked for; Spark broadcasts the key list
    if its size allows and joins by sorting if not.
    """
    hits = live(log.join(keys.select("k").distinct(), "k", "left_semi")).select("k", "v", F.lit(True).alias("__hit"))
    return keys.join(hits, "k", "left").select("pos", "k", F.coalesce("__hit", F.lit(False)).alias("found"), "v")


def misses(lookups: DataFrame) -> DataFrame:
    """One row ``(lookups, misses)``; a found null is no miss."""
    return lookups.agg(F.count(F.lit(1)).alias("lookups"), F.count_if(~F.col("found")).alias("misses"))


def absent(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` without a live value; only the writes of these keys are resolved."""
    asked = log.select("k", "seq", "op").join(keys.select("k").distinct(), "k", "left_semi")
    return keys.join(newest(asked).where(F.col("op") == PUT).select("k"), "k", "left_anti")


def semi_filter(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The writes whose key is in ``keys``: what a Bloom filter approximates, exactly."""
    return log.join(keys.select("k"), "k", "left_semi")


def sorted_scan(log: DataFrame) -> DataFrame:
    """``(pos, k, v)``: the live keys in order, for a client that pulls them one by one with ``toLocalIterator``."""
    return positioned(live(log), ["k"]).select("pos", "k", "v")


def sorted_versions(log: DataFrame) -> DataFrame:
    """All writes by key and sequence, with ``pos``."""
    return positioned(log.select(*COLUMNS), ["k", "seq"]).select("pos", *COLUMNS)


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """All versions and tombstones of runs given oldest first, as ``(pos, k, run, seq, op, v)`` in merged order."""
    tagged = [r.select(*COLUMNS).withColumn("run", F.lit(i).cast("bigint")) for i, r in enumerate(runs)]
    union = tagged[0]
    for r in tagged[1:]:
        union = union.unionByName(r)
    return merge_run_rows(union)


def merge_run_rows(rows: DataFrame) -> DataFrame:
    """As ``merge_runs``, of rows that carry their ``run``."""
    return positioned(rows, ["k", "run", "seq"]).select("pos", "k", "run", "seq", "op", "v")


def compacted(log: DataFrame, keep_tombstones: bool = False) -> DataFrame:
    """The newest write of each key.  Tombstones may go only if ``log`` is the whole history of its keys."""
    out = newest(log).select(*COLUMNS)
    return out if keep_tombstones else out.where(F.col("op") != DELETE)
