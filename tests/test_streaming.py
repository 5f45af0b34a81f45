"""A streaming log ends in the batch view, also when it is stopped and started again."""

from millrace.operators import resolve
from millrace.sources.storage import RunStore
from millrace.streaming import upsert

SCHEMA = "k bigint, seq bigint, op string, v string"


def live(df):
    return sorted((r["k"], r["seq"], r["v"]) for r in df.collect())


def test_restart_from_the_checkpoint(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    late = [(1, 5, "P", "a5"), (2, 1, "P", "b1"), (1, 3, "P", "a3")]
    more = [(2, 9, "D", None), (3, 2, "P", "c2"), (1, 4, "P", "a4")]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.parquet(src)
    stream = lambda: upsert.read_stream(spark, src, "*.parquet", spark.createDataFrame([], SCHEMA).schema)
    upsert.run_upsert(stream(), out, cp).awaitTermination()
    assert live(upsert.upserted(spark, out)) == [(1, 5, "a5"), (2, 1, "b1")]
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    upsert.run_upsert(stream(), out, cp).awaitTermination()
    assert live(upsert.upserted(spark, out)) == live(resolve.live(spark.createDataFrame(late + more, SCHEMA))) == [(1, 5, "a5"), (3, 2, "c2")]


def test_batches_become_runs(spark, tmp_path):
    src, root, cp = (str(tmp_path / x) for x in ("src", "root", "cp"))
    for part in ([(1, 1, "P", "x")], [(1, 2, "D", None), (2, 3, "P", "y")]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = upsert.read_stream(spark, src, "*.parquet", spark.createDataFrame([], SCHEMA).schema)
    upsert.run_store_writer(stream, "file://" + root, cp).awaitTermination()
    store = RunStore(spark, "file://" + root)
    assert len(store.runs()) == 2 and live(resolve.live(store.read())) == [(2, 3, "y")]


def test_many_batches_are_merged_and_counted_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upsert, "MAX_RUNS", 2)
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    rows = []
    for i in range(6):
        part = [(i % 3, i, "D" if i == 4 else "P", None if i == 4 else f"v{i}")]
        rows += part
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = upsert.read_stream(spark, src, "*.parquet", spark.createDataFrame([], SCHEMA).schema)
    upsert.run_upsert(stream, out, cp).awaitTermination()
    store = RunStore(spark, out)
    assert len(store.runs()) <= 2 and live(upsert.upserted(spark, out)) == [(0, 3, "v3"), (2, 5, "v5")]
    # A batch that comes again is in already.
    before = store.runs()
    store.add(spark.createDataFrame(rows, SCHEMA), name=before[-1])
    assert store.runs() == before
