"""Positions in a global or grouped order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.storage import dropping_shuffles, materialize


def positioned(df: DataFrame, order: list[str], group: list[str] = (), name: str = "pos") -> DataFrame:
    """Add ``name``: the 1-based place of each row by ``order`` among its ``group`` (or all) rows.

    Rows are range-partitioned and sorted, numbered in their partition, and
    shifted by the rows of their group in the partitions before, which is a
    table of a row for each group and partition that holds it.  Groups are few
    (shards), so that table has little over a row for each partition and is
    broadcast; the rows themselves aren't shuffled a second time.  A null is a
    group too.  The sorted rows stay on shared storage until the result is
    discarded.
    """
    keys = [*group, *order]
    # Partition number and place in it, in one number.
    with dropping_shuffles(df.sparkSession):
        dealt = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    starts = dealt.groupBy(*group, part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = starts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).select(*group, "__part", "__first", "__before")
    same = F.col("d.__part") == F.col("s.__part")
    for c in group:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}"))
    met = dealt.withColumn("__part", part).alias("d").join(F.broadcast(shifts.alias("s")), same)
    out = met.select(*(F.col(f"d.{c}") for c in df.columns), (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias(name))
    out._millrace_path = dealt._millrace_path
    return out
