"""Shards, blocks, runs and the table facade."""

import pytest
from pyspark.sql import functions as F

from millrace.functions.records import shard_of
from millrace.operators.order import positioned
from millrace.plans import layout
from millrace.plans.table import Config, MutationTable
from millrace.sources.storage import RunStore


def numbers(spark, n, shards=2):
    return spark.range(n).select(F.col("id").alias("k"), F.col("id").alias("seq"), F.lit("P").alias("op"), F.col("id").cast("string").alias("v"))


@pytest.mark.parametrize(("rows", "active", "sealed"), [(8, 0, 2), (10, 2, 2), (0, 0, 0)])
def test_block_edges(spark, rows, active, sealed):
    log = numbers(spark, rows), shard_of(F.col("k"), 2), 4
    got = layout.states(*log).first()
    assert (got["active_records"], got["sealed_blocks"], got["sealed_records"], got["sorted_blocks"]) == (active, sealed, 4 * sealed, 0)
    drained = layout.states(*log, drained=True).first()
    assert (drained["sorted_records"], drained["active_records"], drained["sealed_blocks"]) == (rows, 0, 0)


def test_backlog_and_zone_map(spark):
    log = numbers(spark, 24), shard_of(F.col("k"), 2), 4
    blocked = layout.blocks(*log)
    assert tuple(layout.backlog(*log, 5).first()) == (6, 1, True)
    assert tuple(layout.backlog(*log, 6).first()) == (6, 0, False)
    zones = {(r["shard"], r["block"]): (r["min_key"], r["max_key"], r["rows"]) for r in layout.zone_map(blocked).collect()}
    assert zones[(0, 0)] == (0, 6, 4) and zones[(1, 2)] == (17, 23, 4)


def test_sparse_index_takes_every_sixteenth(spark):
    got = sorted(tuple(r) for r in layout.sparse_index(numbers(spark, 70), shard_of(F.col("k"), 2)).collect())
    assert got == [(0, 0, 0), (0, 16, 32), (0, 32, 64), (1, 0, 1), (1, 16, 33), (1, 32, 65)]


def test_positions_are_gapless_over_partitions(spark):
    got = positioned(numbers(spark, 1000).repartition(7), ["k"]).collect()
    assert sorted((r["k"], r["pos"]) for r in got) == [(i, i + 1) for i in range(1000)]


def test_settings_are_normalised():
    c = Config(num_shards=9, batch_worker_count=0)
    assert [Config(num_shards=n).shards for n in (0, 1, 2, 3, 16)] == [1, 1, 2, 4, 16]
    assert (Config().block_rows, c.shards, c.workers, Config(active_block_size_bytes=4 << 20).block_rows, Config(active_block_size_bytes=1).block_rows) == (6779, 16, 1, 36157, 1)


def table(spark, tmp_path, **more):
    return MutationTable.create(spark, root="file://" + str(tmp_path / "t"), key_type="string", value_type="string", **more)


@pytest.mark.parametrize("compaction", [False, True])
def test_a_table_from_first_write_to_last_read(spark, tmp_path, compaction):
    t = table(spark, tmp_path, enable_compaction=compaction)
    t.put("apple", "red")
    t.put("banana", "yellow")
    t.delete("banana")
    t.put("null", None)
    assert t.get("apple") == "red" and t.get("banana") is None and t.found("null") and not t.found("banana")
    t.put_batch([("same", "v1"), ("other", "x"), ("same", "v2"), ("same", "v3")])
    t.wait_for_background_work()
    t.put("apple", "green")
    assert t.multi_get(["same", "banana", "apple", "same", "nothing"]) == ["v3", None, "green", "v3", None]
    assert [(r["k"], r["v"]) for r in t.iterate()] == [("apple", "green"), ("null", None), ("other", "x"), ("same", "v3")]
    again = table(spark, tmp_path)
    assert again.get("apple") == "green"
    again.put("apple", "last")
    assert again.get("apple") == "last"


def test_a_framed_batch_and_compactions(spark, tmp_path):
    t = table(spark, tmp_path)
    t.put("old", "1")
    batch = spark.range(2048).select(F.concat(F.lit("k"), "id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.col("id").alias("n"))
    t.put_batch(batch, "n")
    t.delete("old")
    t.delete("k5")
    t.seal()
    t.compact_newest(2)
    assert t.log().where("op = 'D'").count() == 2 and t.get("old") is None and t.get("k5") is None and t.get("k2047") == "v2047"
    t.compact()
    assert t.log().where("op = 'D'").count() == 0 and t.log().count() == 2047 and len(t.store.runs()) == 1
    assert t.states(drained=True)["sorted_records"] == 2047 and t.storage()["files"] >= 1
    with pytest.raises(ValueError):
        t.put_batch(batch)


def test_a_bad_row_fails_the_whole_batch(spark, tmp_path):
    t = table(spark, tmp_path)
    with pytest.raises(ValueError):
        t.put_batch([(f"k{i}", "v") for i in range(300)] + [("big", "x" * 40_000)])
    with pytest.raises(ValueError):
        t.put(None, "v")
    assert t.log().count() == 0 and t.multi_get([]) == []
    frame = spark.createDataFrame([("a", "1", 0), ("b", "x" * 40_000, 1)], "k string, v string, n bigint")
    with pytest.raises(Exception, match="bytes"):
        t.put_batch(frame, "n")
    assert t.log().count() == 0


def test_sealed_runs_wait_to_be_sorted(spark, tmp_path):
    t = table(spark, tmp_path, async_background_processing=False)
    for k in ("b", "a", "c"):
        t.put(k, k)
        t.put("z" + k, k)
        t.seal()
    assert t.pending() == 3 and t.get("a") == "a"
    t.wait_for_background_backlog_at_most(1)
    assert t.pending() == 1 and len(t.store.runs()) == 3
    t.wait_for_background_work()
    assert t.pending() == 0 and len(t.store.runs()) == 3
    beside = MutationTable.create(spark, root="file://" + str(tmp_path / "u"), key_type="string", value_type="string")
    for i in range(3):
        beside.put(f"k{i}", "v")
        beside.seal()
    beside.close()
    assert beside.pending() == 0 and beside.get("k2") == "v" and len(beside.store.runs()) == 3


def test_workers_are_the_tasks_that_write_a_batch(spark, tmp_path):
    t = table(spark, tmp_path, batch_worker_count=3, async_background_processing=False)
    t.put_batch(spark.range(300).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("v").alias("v"), F.col("id").alias("n")), "n")
    assert t.storage()["files"] == 3


def test_a_sorter_of_ones_own(spark, tmp_path):
    backwards = lambda log: log.sortWithinPartitions(F.desc("k"))
    t = MutationTable.create(spark, root="file://" + str(tmp_path / "t"), key_type="string", value_type="string", sorter=backwards)
    t.put_batch([(f"k{i:03d}", str(i)) for i in range(200)])
    t.close()
    rows = spark.read.parquet(f"{t.store.root}/runs/{t.store.runs()[0]}").select("k", F.input_file_name().alias("f")).collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r["f"], []).append(r["k"])
    assert all(x == sorted(x, reverse=True) for x in by_file.values()) and t.get("k007") == "7" and t.scan().first()["k"] == "k000"


def test_two_writers_at_once_lose_no_run(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = "file://" + str(tmp_path / "runs")
    with ThreadPoolExecutor(4) as pool:
        names = list(pool.map(lambda i: RunStore(spark, root).add(numbers(spark, 5), 1), range(8)))
    assert sorted(RunStore(spark, root).runs()) == sorted(names) and RunStore(spark, root).read().count() == 40


def test_a_point_read_opens_the_files_of_one_shard(spark, tmp_path):
    store = RunStore(spark, "file://" + str(tmp_path / "runs"))
    path = store.write_blocks(layout.blocks(numbers(spark, 64), shard_of(F.col("k"), 4), 8))
    read = spark.read.parquet(path).where("shard = 3 and k = 7")
    assert read.count() == 1 and read.select("block").first()[0] == 0
    scan = next(x for x in read._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x)
    assert "(shard" in scan and "EqualTo(k,7)" in scan


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from millrace.sources import storage

    unset = SimpleNamespace(isDefined=lambda: False)
    java = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(_jsc=java, master=master))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.scratch_root(fake)


def test_a_bloom_filter_rejects_most_that_it_lacks(spark):
    from millrace.functions import bloom

    bits, hashes = 1 << 14, bloom.hash_count(1 << 14, 1000)
    words = bloom.build(spark.range(1000).select(F.col("id").alias("k")), bits, hashes)
    probed = bloom.may_contain(spark.range(3000).select(F.col("id").alias("k")), words, bits, hashes)
    got = {r["k"]: r["may"] for r in probed.collect()}
    assert all(got[i] for i in range(1000)) and sum(got[i] for i in range(1000, 3000)) < 40
    assert (bloom.hash_count(1, 100), bloom.hash_count(10**6, 1)) == (1, 8)
    assert bloom.may_contain(spark.createDataFrame([(None,)], "k bigint"), words, bits, hashes).first()["may"] is None
    empty = bloom.build(spark.range(0).select(F.col("id").alias("k")), bits, hashes)
    assert not bloom.may_contain(spark.range(1).select(F.col("id").alias("k")), empty, bits, hashes).first()["may"]


def test_tables_are_apart(spark):
    first, second = MutationTable.create(spark, key_type="string", value_type="string"), MutationTable.create(spark, key_type="string", value_type="string")
    first.put("only", "old")
    second.put("mine", "new")
    assert second.get("only") is None and second.get("mine") == "new"


def test_runs_are_in_key_order_and_snapshots_stay(spark, tmp_path):
    store = RunStore(spark, "file://" + str(tmp_path / "runs"))
    store.add(numbers(spark, 100).orderBy(F.desc("k")), 2)
    before = store.read()
    store.add(numbers(spark, 10))
    assert before.count() == 100 and store.read().count() == 110
    first = spark.read.parquet(f"{store.root}/runs/{store.runs()[0]}").select("k", F.input_file_name().alias("f")).collect()
    by_file = {}
    for r in first:
        by_file.setdefault(r["f"], []).append(r["k"])
    assert all(x == sorted(x) for x in by_file.values())
