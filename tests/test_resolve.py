"""Last write wins, on the fixtures of the survey and on the cases that they leave out."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.records import first_byte, key_prefix
from millrace.operators import resolve, stats
from millrace.sources.log import appended, batch_log, checked, duplicate_sequences

SCHEMA = "k string, seq bigint, op string, v string"
BYTES = "k binary, seq bigint, op string, v string"


def log_of(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def numbered(writes):
    return [(k, i, op, v) for i, (k, op, v) in enumerate(writes)]


def live(log):
    return {r["k"]: r["v"] for r in resolve.live(log).collect()}


def test_overwrite_delete_and_put_again(spark):
    log = log_of(spark, numbered([("a", "P", "1"), ("b", "P", "2"), ("a", "P", "3"), ("b", "D", None), ("c", "D", None), ("d", "P", "4"), ("d", "D", None), ("d", "P", "5")]))
    assert live(log) == {"a": "3", "d": "5"}


def test_scan_is_sorted_after_overwrite_and_delete(spark):
    log = log_of(spark, numbered([("c", "P", "3"), ("a", "P", "1"), ("e", "P", "5"), ("b", "P", "2"), ("d", "P", "4"), ("c", "P", "3_new"), ("a", "D", None)]))
    got = [(r["pos"], r["k"], r["v"]) for r in resolve.sorted_scan(log).orderBy("pos").collect()]
    assert got == [(1, "b", "2"), (2, "c", "3_new"), (3, "d", "4"), (4, "e", "5")]


@pytest.mark.parametrize("last", [("P", "v99"), ("D", None)])
def test_long_runs_of_versions(spark, last):
    writes = [("k", "P", f"v{i}") for i in range(99)] + [("k", *last)]
    assert live(log_of(spark, numbered(writes))) == ({} if last[0] == "D" else {"k": "v99"})


def test_multi_get_keeps_positions_and_duplicates(spark):
    log = log_of(spark, numbered([("a", "P", "1"), ("b", "P", "2"), ("c", "P", "3"), ("b", "D", None), ("d", "P", "4"), ("e", "P", "")]))
    keys = spark.createDataFrame(list(enumerate(["a", "b", "c", "a", "d", "missing", "e"])), "pos bigint, k string")
    got = sorted((r["pos"], r["found"], r["v"]) for r in resolve.multi_get(log, keys).collect())
    assert got == [(0, True, "1"), (1, False, None), (2, True, "3"), (3, True, "1"), (4, True, "4"), (5, False, None), (6, True, "")]


def test_a_put_of_null_is_no_miss(spark):
    log = log_of(spark, [("a", 1, "P", None), ("b", 2, "D", None)])
    keys = spark.createDataFrame([(0, "a"), (1, "b")], "pos bigint, k string")
    assert resolve.misses(resolve.multi_get(log, keys)).first().asDict() == {"lookups": 2, "misses": 1}


def test_unsigned_byte_order_of_random_keys(spark):
    luck = random.Random(9)
    keys = [luck.randbytes(16) for _ in range(1024)]
    got = [bytes(r["k"]) for r in resolve.sorted_scan(log_of(spark, [(bytearray(k), i, "P", "v") for i, k in enumerate(keys)], BYTES)).orderBy("pos").collect()]
    assert got == sorted(set(keys))


def test_order_of_short_and_high_keys(spark):
    keys = [b"", b"a", b"a\0", b"a\0b", b"abcdefgh", b"abcdefgh\0", b"\x7f", b"\x80", b"\xff\xff"]
    log = log_of(spark, [(bytearray(k), i, "P", "v") for i, k in enumerate(keys)], BYTES)
    assert [bytes(r["k"]) for r in resolve.sorted_scan(log).orderBy("pos").collect()] == sorted(keys)


def test_late_rows_lose_and_snapshots_see_the_past(spark):
    log = log_of(spark, [("a", 5, "P", "new"), ("a", 3, "P", "old"), ("a", 9, "D", None)])
    assert live(log) == {}
    assert live(resolve.as_of(log, 8)) == {"a": "new"}
    assert live(resolve.as_of(log, 4)) == {"a": "old"}


def test_partial_compaction_keeps_tombstones(spark):
    old = log_of(spark, [("a", 1, "P", "1"), ("b", 2, "P", "2")])
    new = log_of(spark, [("a", 3, "D", None), ("b", 4, "P", "5"), ("b", 5, "P", "6")])
    kept = resolve.compacted(new, keep_tombstones=True)
    assert kept.count() == 2
    assert live(appended(old, kept)) == {"b": "6"}
    assert live(appended(old, resolve.compacted(new))) == {"a": "1", "b": "6"}


def test_merge_of_runs_keeps_all_versions(spark):
    runs = [log_of(spark, [("b", 1, "P", "1"), ("a", 2, "P", "2")]), log_of(spark, [("a", 3, "D", None)])]
    got = [(r["k"], r["run"], r["op"]) for r in resolve.merge_runs(runs).orderBy("pos").collect()]
    assert got == [("a", 0, "P"), ("a", 1, "D"), ("b", 0, "P")]


def test_empty_logs_and_key_lists(spark):
    log = log_of(spark, [])
    keys = spark.createDataFrame([], "pos bigint, k string")
    assert resolve.sorted_scan(log).collect() == []
    assert resolve.multi_get(log, keys).collect() == []
    assert stats.flush_summary(log).first().asDict() == {"rows": 0, "bytes": 0, "checksum": 0}
    assert resolve.live(log).columns == ["k", "seq", "v"]


def test_batches_follow_their_ordinals(spark):
    batch = spark.createDataFrame([("same", "v3", 3), ("same", "v1", 0), ("other", "x", 1), ("same", "v2", 2)], "k string, v string, n bigint")
    assert live(batch_log(batch, "k", "v", "n", 100)) == {"same": "v3", "other": "x"}


@pytest.mark.parametrize("row", [(None, 1, "P", "v"), ("k", None, "P", "v"), ("k", 1, "X", "v"), ("k", 1, "P", "x" * 32_768)])
def test_bad_records_fail(spark, row):
    with pytest.raises(Exception, match="null|neither|bytes"):
        checked(log_of(spark, [("fine", 1, "P", "v"), row])).collect()


def test_a_record_at_the_limit_passes(spark):
    assert checked(log_of(spark, [("k", 1, "P", "x" * 32_767)])).count() == 1


def test_duplicate_sequences_are_found(spark):
    assert [tuple(r) for r in duplicate_sequences(log_of(spark, [("a", 1, "P", "x"), ("a", 1, "P", "y"), ("a", 2, "P", "z")])).collect()] == [("a", 1, 2)]


def test_key_functions(spark):
    row = spark.createDataFrame([("ab", "", "Ünë")], "a string, b string, c string").select(
        key_prefix(F.col("a")).alias("a"), key_prefix(F.col("b")).alias("b"), key_prefix(F.col("c")).alias("c"), first_byte(F.col("a")).alias("x"), first_byte(F.col("b")).alias("y")
    ).first()
    assert row["a"] == "6162000000000000" and row["b"] == "0" * 16 and row["c"].startswith("C39C6EC3AB") and (row["x"], row["y"]) == (97, 0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("PPD"), st.text("xyz", max_size=3)), max_size=40))
def test_any_log_equals_a_dictionary(spark, writes):
    model = {}
    for k, op, v in writes:
        if op == "P":
            model[k] = v
        else:
            model.pop(k, None)
    rows = numbered([(k, op, v if op == "P" else None) for k, op, v in writes])
    random.Random(1).shuffle(rows)
    assert live(log_of(spark, rows)) == model


def test_point_filter_reaches_the_scan(spark, tmp_path):
    log_of(spark, numbered([(c, "P", c) for c in "abc"])).write.parquet(str(tmp_path / "log"))
    plan = resolve.get(spark.read.parquet(str(tmp_path / "log")), F.lit("b"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,b)" in plan and "WindowGroupLimit" in plan
