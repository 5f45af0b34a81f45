"""Stored blocks: few files however many blocks there are, and nothing left out."""

from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from millrace import queries
from millrace.functions.records import shard_of
from millrace.plans import layout
from millrace.sources.storage import RunStore

EVENTS = "event_id bigint, user_id bigint, event_type string, props string"


def test_many_blocks_lie_in_few_files(spark, tmp_path):
    log = spark.range(4096).select("id", (F.col("id") * 7919 % 4096).alias("k"))
    log = log.select("k", F.col("id").alias("seq"), F.lit("P").alias("op"), F.col("k").cast("string").alias("v"))
    store = RunStore(spark, "file://" + str(tmp_path / "runs"))
    blocked = layout.blocks(log, shard_of(F.col("k"), 4), 8)
    path = store.write_blocks(blocked)
    files = list(Path(path.removeprefix("file://")).rglob("part-*.parquet"))
    assert len(files) <= 16 and {f.parent.name for f in files} == {f"shard={i}" for i in range(4)}
    assert store.read_blocks(path, blocked).select(sorted(blocked.columns)).exceptAll(blocked.select(sorted(blocked.columns))).count() == 0
    homes = {}
    for f in files:
        rows = duckdb.connect().execute(f"select block, k from '{f}'").fetchall()
        assert rows == sorted(rows)
        for block, k in rows:
            homes.setdefault((f.parent.name, block), []).append((f.name, k))
    # 512 blocks, each whole in one file.
    assert len(homes) == 512 and all(len(rows) == 8 and len({f for f, _ in rows}) == 1 for rows in homes.values())


def test_rows_are_shuffled_once_for_their_blocks(spark):
    log = spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias("seq"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = layout.blocks(log, shard_of(F.col("k"), 4), 8)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_a_point_read_of_an_empty_log(spark, tmp_path):
    spark.createDataFrame([], EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in queries.QUERIES["get_from_blocks"](spark, f"file://{tmp_path}").collect()] == [(0, 7, False, None)]


def test_the_stored_zone_map_of_odd_logs(spark, tmp_path):
    """No rows; and keys that are null, which have blocks of their own as in the SQL."""
    rows = [(i, None if i % 3 == 0 else i % 40, "view", "x") for i in range(900)]
    for name, data in (("none", []), ("nulls", rows)):
        spark.createDataFrame(data, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
        got = queries.QUERIES["stored_block_min_max"](spark, f"file://{tmp_path}/{name}")
        con = duckdb.connect()
        con.execute(f"create view events as select * from '{tmp_path}/{name}/events.parquet/*.parquet'")
        want = con.execute(f"select shard, block, min_key, max_key, rows from ({queries.ORACLES['stored_block_min_max']})").fetchall()
        assert sorted(map(repr, (tuple(r) for r in got.select("shard", "block", "min_key", "max_key", "rows").collect()))) == sorted(map(repr, want))
        assert dict(got.dtypes) == {"shard": "bigint", "block": "bigint", "min_key": "bigint", "max_key": "bigint", "rows": "bigint"}
