"""The live view of a log that keeps arriving."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from millrace.operators.resolve import compacted, live
from millrace.sources.storage import RunStore, scratch_path


def newest_by_key(log: DataFrame) -> DataFrame:
    """``(k, seq, op, v)``: the newest write of each key of a streaming or static log.

    The greatest ``(seq, op, v)`` is one aggregate, whose state is a row for
    each key; a write that arrives late with a lower ``seq`` loses.
    """
    return log.groupBy("k").agg(F.max(F.struct("seq", "op", "v")).alias("w")).select("k", "w.seq", "w.op", "w.v")


def read_stream(spark: SparkSession, folder: str, files: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    """Parquet files that match ``files`` as they appear, at most ``per_trigger`` of them at a time."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger).parquet(folder)


#: Runs that a view is read from before they are merged.
MAX_RUNS = 8


def run_upsert(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Maintain the newest writes in runs under ``target``: each batch adds the keys that it changed.

    A batch's run is named by the batch's number, so one that is repeated after
    a failure changes nothing.  Over ``MAX_RUNS`` runs are merged into one,
    which keeps tombstones and the names of the batches that it holds.
    """

    def write(batch: DataFrame, number: int) -> None:
        store = RunStore(batch.sparkSession, target)
        held = store.runs()
        # Batches come in order, so those up to the newest one named are in.
        if any(int(n.rsplit("-", 1)[1]) >= number for n in held):
            return
        store.add(batch, name=f"run-batch-{number:010d}")
        names = store.runs()
        if len(names) > MAX_RUNS:
            merged = store.write(compacted(store.read(names), keep_tombstones=True), name=f"run-merged-{uuid.uuid4().hex}-{number:010d}")
            store.replace(names, merged)

    return newest_by_key(log).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, target: str) -> DataFrame:
    """``(k, seq, v)``: the live view from all updates, of which the newest counts."""
    return live(RunStore(spark, target).read())


def run_store_writer(log: DataFrame, store_root: str, checkpoint: str) -> StreamingQuery:
    """Append every batch of a log as a sorted run of its own, named by the batch's number and so added once."""

    def write(batch: DataFrame, number: int) -> None:
        RunStore(batch.sparkSession, store_root).add(batch, name=f"run-batch-{number:010d}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_once(log: DataFrame) -> DataFrame:
    """Run a streaming log to its end and return its live view."""
    spark = log.sparkSession
    target = scratch_path(spark, "upsert")
    query = run_upsert(log, f"{target}/view", f"{target}/checkpoint")
    query.awaitTermination()
    return upserted(spark, f"{target}/view")
