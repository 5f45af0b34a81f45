"""The mutation log: one row ``(k, seq, op, v)`` for every write.

``k`` is the key, of any type that can be ordered; ``seq`` a total order of the
writes, unique per key; ``op`` is ``P`` for a put and ``D`` for a delete; ``v``
is the value, null for a delete.  A put of null or of an empty value is still a
put.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.records import MAX_RECORD_BYTES, record_bytes

PUT, DELETE = "P", "D"
COLUMNS = ["k", "seq", "op", "v"]


def log_from(df: DataFrame, key: Column | str, seq: Column | str, value: Column | str, deleted: Column | None = None) -> DataFrame:
    """A log of the rows of ``df``; those for which ``deleted`` holds are deletes."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    value = col(value)
    return df.select(
        col(key).alias("k"),
        col(seq).cast("bigint").alias("seq"),
        F.when(gone, F.lit(DELETE)).otherwise(F.lit(PUT)).alias("op"),
        F.when(~gone, value).alias("v"),
    )


def checked(log: DataFrame, max_record_bytes: int | None = MAX_RECORD_BYTES) -> DataFrame:
    """The log, failing at run time on a null key, a null sequence, an unknown op or an oversized record.

    The check is part of the plan, so nothing is written or returned of a
    batch that holds a bad row.
    """
    wrong = (
        F.when(F.col("k").isNull(), F.lit("a key is null"))
        .when(F.col("seq").isNull(), F.lit("a sequence number is null"))
        .when(F.col("op").isNull() | ~F.col("op").isin(PUT, DELETE), F.lit("an operation is neither P nor D"))
    )
    if max_record_bytes is not None:
        wrong = wrong.when(record_bytes(F.col("k"), F.col("v")) > max_record_bytes, F.lit(f"a record has over {max_record_bytes} bytes"))
    kept = log.select(*COLUMNS, wrong.alias("wrong"))
    return kept.where(F.when(F.col("wrong").isNotNull(), F.raise_error(F.col("wrong")).cast("boolean")).otherwise(F.lit(True))).select(*COLUMNS)


def duplicate_sequences(log: DataFrame) -> DataFrame:
    """``(k, seq, n)`` of writes that the sequence leaves in no order; empty for a sound log."""
    return log.groupBy("k", "seq").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def fitting(log: DataFrame, max_record_bytes: int = MAX_RECORD_BYTES) -> DataFrame:
    """The records within the size limit."""
    return log.where(record_bytes(F.col("k"), F.col("v")) <= max_record_bytes)


def appended(log: DataFrame, *batches: DataFrame) -> DataFrame:
    """The log with further writes; who wins is decided by ``seq`` alone."""
    for batch in batches:
        log = log.unionByName(batch.select(*COLUMNS))
    return log


def batch_log(batch: DataFrame, key: str, value: str, ordinal: str, base: int) -> DataFrame:
    """A put for every row of a batch, after ``base`` in the order of ``ordinal``."""
    return log_from(batch, key, F.lit(base) + F.col(ordinal), value)
