"""Counters over logs, blocks and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.records import first_byte, record_bytes
from millrace.operators.resolve import live
from millrace.sources.log import DELETE


def flush_summary(log: DataFrame) -> DataFrame:
    """One row ``(rows, bytes, checksum)`` of a flush: live rows, their bytes, the sum of the keys' first bytes."""
    return live(log).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(record_bytes(F.col("k"), F.col("v"))), F.lit(0)).cast("bigint").alias("bytes"),
        F.coalesce(F.sum(first_byte(F.col("k"))), F.lit(0)).cast("bigint").alias("checksum"),
    )


def storage_stats(stored: DataFrame) -> DataFrame:
    """One row ``(files, size_bytes)``: the files that a frame is read from and their size on storage.

    ``stored`` is read from files and carries their metadata; it is looked at
    where it lies, a row for each task and file.
    """
    files = stored.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("size_bytes"))


def logical_size(log: DataFrame) -> DataFrame:
    """One row ``(records, tombstones, key_bytes, value_bytes)``: what the writes take up apart from any format."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    keys, all_of_it = record_bytes(F.col("k"), F.lit(None)), record_bytes(F.col("k"), F.col("v"))
    return log.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("op") == DELETE).alias("tombstones"), total(keys).alias("key_bytes"), total(all_of_it - keys).alias("value_bytes"))
