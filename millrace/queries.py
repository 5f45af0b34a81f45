"""The registered queries on the test tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import bloom
from millrace.functions.records import hash_shard, key_prefix, shard_of
from millrace.operators import resolve, stats
from millrace.plans import layout
from millrace.plans.table import Config, MutationTable
from millrace.sources.log import appended, fitting, log_from
from millrace.sources.storage import RunStore, discard, scratch_path
from millrace.streaming import upsert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS, BLOCK_ROWS, BACKLOG, SNAPSHOT = 16, 64, 16, 5_000
BLOOM_BITS, BLOOM_KEYS = 1 << 16, 8_000

#: SQL of the logs, and of the newest write of each key in them.
_LOGS = {
    "ev": "select user_id as k, event_id as seq, case when event_type = 'error' then 'D' else 'P' end as op, case when event_type <> 'error' then props end as v from events",
    "od": "select o_custkey as k, o_orderkey as seq, case when o_orderstatus = 'P' then 'D' else 'P' end as op, case when o_orderstatus <> 'P' then o_orderpriority end as v from orders",
    "cv": "select conv_id as k, turn as seq, 'P' as op, text as v from conversations",
    "pg": "select url as k, page_id as seq, 'P' as op, html as v from pages",
    "dc": "select doc_id as k, doc_id as seq, 'P' as op, text as v from documents",
}


def _with(*logs: str, **more: str) -> str:
    """A WITH clause of logs, of further named logs, and of ``<log>_new``, the newest write of each key."""
    texts = {name: _LOGS[name] for name in logs} | more
    out = [f"{name} as ({sql})" for name, sql in texts.items()]
    out += [f"{name}_new as (select k, seq, op, v from (select *, row_number() over (partition by k order by seq desc) as r from {name}) where r = 1)" for name in texts]
    return "with " + ", ".join(out) + " "


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_from(_read(spark, sf_dir, "events"), "user_id", "event_id", "props", F.col("event_type") == "error")


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_from(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority", F.col("o_orderstatus") == "P")


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_from(_read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def pages_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_from(_read(spark, sf_dir, "pages"), "url", "page_id", "html")


def documents_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_from(_read(spark, sf_dir, "documents"), "doc_id", "doc_id", "text")


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# Sources


@query(_LOGS["ev"])
def log_source(spark, sf_dir):
    return events_log(spark, sf_dir)


@query(_with("dc") + "select k, octet_length(encode(v)) as bytes from dc where octet_length(encode(cast(k as varchar))) + octet_length(encode(v)) <= 32768")
def record_size_limit(spark, sf_dir):
    return fitting(documents_log(spark, sf_dir)).select("k", F.octet_length("v").cast("bigint").alias("bytes"))


# Resolution


@query(_with("ev") + "select k, seq, v from ev_new where op = 'P'")
def compact_latest(spark, sf_dir):
    return resolve.live(events_log(spark, sf_dir))


@query(_with("od") + "select * from od_new")
def latest_with_tombstones(spark, sf_dir):
    return resolve.newest(orders_log(spark, sf_dir))


@query(_with("cv") + "select k, seq, v from cv_new where op = 'P'")
def batch_overwrite_order(spark, sf_dir):
    return resolve.live(conversations_log(spark, sf_dir))


@query(_with(was=f"select * from ({_LOGS['ev']}) where seq <= {SNAPSHOT}") + "select k, seq, v from was_new where op = 'P'")
def snapshot_as_of(spark, sf_dir):
    return resolve.live(resolve.as_of(events_log(spark, sf_dir), SNAPSHOT))


# Writes


def _later(log: DataFrame, where, op: str, value) -> DataFrame:
    """One more write, after all others, for each key of a log that meets a condition."""
    keys = log.select("k").distinct().where(where)
    return keys.select("k", (F.lit(1_000_000_000) + F.col("k")).alias("seq"), F.lit(op).alias("op"), value.cast("string").alias("v"))


@query(_with(put=f"{_LOGS['ev']} union all select distinct user_id, 1000000000 + user_id, 'P', 'new ' || user_id from events where user_id % 3 = 0") + "select k, seq, v from put_new where op = 'P'")
def put_overwrite(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return resolve.live(appended(log, _later(log, F.col("k") % 3 == 0, "P", F.concat(F.lit("new "), F.col("k")))))


@query(_with(gone=f"{_LOGS['ev']} union all select distinct user_id, 1000000000 + user_id, 'D', null from events where user_id % 4 = 0") + "select k, seq, v from gone_new where op = 'P'")
def delete_tombstones(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return resolve.live(appended(log, _later(log, F.col("k") % 4 == 0, "D", F.lit(None))))


@query(
    _with(joint=f"{_LOGS['ev']} union all select c_custkey, 2000000000 + c_custkey, 'P', c_name from customer union all select c_custkey, 3000000000 + c_custkey, 'P', c_mktsegment from customer where c_custkey % 2 = 0")
    + "select k, seq, v from joint_new where op = 'P'"
)
def put_batch_union(spark, sf_dir):
    customers = _read(spark, sf_dir, "customer")
    first = log_from(customers, "c_custkey", F.lit(2_000_000_000) + F.col("c_custkey"), "c_name")
    second = log_from(customers.where(F.col("c_custkey") % 2 == 0), "c_custkey", F.lit(3_000_000_000) + F.col("c_custkey"), "c_mktsegment")
    return resolve.live(appended(events_log(spark, sf_dir), first, second))


# Lookups


def _one(spark, sf_dir, key):
    asked = spark.range(1).select(F.lit(0).cast("bigint").alias("pos"), key.cast("bigint").alias("k"))
    return resolve.multi_get(events_log(spark, sf_dir).where(F.col("k") == key), asked)


def _one_sql(key: str) -> str:
    return _with("ev") + f"select cast(0 as bigint) as pos, cast({key} as bigint) as k, n.k is not null as found, n.v from (select 1) left join (select * from ev_new where op = 'P' and k = {key}) n on true"


@query(_one_sql("7"))
def get_point(spark, sf_dir):
    return _one(spark, sf_dir, F.lit(7))


@query(_one_sql("-1"))
def get_missing(spark, sf_dir):
    return _one(spark, sf_dir, F.lit(-1))


@query(_with("ev") + "select n.k, n.seq, n.op, false as found from ev_new n where op = 'D'")
def get_deleted(spark, sf_dir):
    log = events_log(spark, sf_dir)
    gone = resolve.newest(log).where(F.col("op") == "D")
    looked_up = resolve.multi_get(log, gone.select(F.col("k").alias("pos"), "k"))
    return gone.join(looked_up.select("k", "found"), "k").select("k", "seq", "op", "found")


_ASK = "select c_custkey as pos, c_custkey as k from customer"
_ASK_TWICE = "select c_custkey as pos, c_custkey % 100 as k from customer"


def _lookup_sql(ask: str, what: str = "a.pos, a.k, n.k is not null as found, n.v") -> str:
    return _with("ev") + f"select {what} from ({ask}) a left join (select * from ev_new where op = 'P') n using (k)"


def _asked(spark, sf_dir, key):
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("pos"), key.cast("bigint").alias("k"))


@query(_lookup_sql(_ASK))
def multi_get(spark, sf_dir):
    return resolve.multi_get(events_log(spark, sf_dir), _asked(spark, sf_dir, F.col("c_custkey")))


@query(_lookup_sql(_ASK_TWICE))
def multi_get_duplicates(spark, sf_dir):
    return resolve.multi_get(events_log(spark, sf_dir), _asked(spark, sf_dir, F.col("c_custkey") % 100))


@query(_lookup_sql(_ASK, "count(*) as lookups, count(*) filter (where n.k is null) as misses"))
def multi_get_misses(spark, sf_dir):
    return resolve.misses(multi_get(spark, sf_dir))


@query(_with("ev") + f"select a.k from ({_ASK}) a where a.k not in (select k from ev_new where op = 'P')")
def get_absent(spark, sf_dir):
    return resolve.absent(events_log(spark, sf_dir), _asked(spark, sf_dir, F.col("c_custkey"))).select("k")


@query("select o_custkey as k, o_orderkey as seq, o_orderpriority as v from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def bloom_semi_join(spark, sf_dir):
    orders = log_from(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority")
    wanted = _read(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("k"))
    return resolve.semi_filter(orders, wanted).select("k", "seq", "v")


# Order


@query(_with("od") + "select row_number() over (order by k) as pos, k, v from od_new where op = 'P'")
def sorted_scan(spark, sf_dir):
    return resolve.sorted_scan(orders_log(spark, sf_dir))


@query(_with("pg") + "select row_number() over (order by k) as pos, k, length(v) as chars from pg_new where op = 'P'")
def sorted_scan_text_keys(spark, sf_dir):
    return resolve.sorted_scan(pages_log(spark, sf_dir)).select("pos", "k", F.length("v").cast("bigint").alias("chars"))


@query(_with("cv") + "select row_number() over (order by k, seq) as pos, k, seq, op, v from cv")
def sorted_versions(spark, sf_dir):
    return resolve.sorted_versions(conversations_log(spark, sf_dir))


@query(_with("ev") + "select row_number() over (order by k, seq % 4, seq) as pos, k, seq % 4 as run, seq, op, v from ev")
def merge_runs(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return resolve.merge_runs([log.where(F.col("seq") % 4 == i) for i in range(4)])


# Layout


_BLOCKS = f"select k, seq, k % {SHARDS} as shard, (row_number() over (partition by k % {SHARDS} order by seq) - 1) // {BLOCK_ROWS} as block from ev"
_SIZES = f"(select shard, block, count(*) as rows from ({_BLOCKS}) group by all)"


def _blocked(spark, sf_dir):
    return layout.blocks(events_log(spark, sf_dir).select("k", "seq"), shard_of(F.col("k"), SHARDS), BLOCK_ROWS)


def _sharded(spark, sf_dir):
    return events_log(spark, sf_dir), shard_of(F.col("k"), SHARDS), BLOCK_ROWS


@query(_with("ev") + f"select k % {SHARDS} as shard, count(*) as records from ev group by 1")
def shard_histogram(spark, sf_dir):
    return layout.shard_sizes(events_log(spark, sf_dir), shard_of(F.col("k"), SHARDS))


@query(_with("ev") + _BLOCKS)
def block_assignment(spark, sf_dir):
    return _blocked(spark, sf_dir).select("k", "seq", "shard", "block")


@query(
    _with("ev") + f"select cast(coalesce(sum(rows) filter (where rows < {BLOCK_ROWS}), 0) as bigint) as active_records, count(*) filter (where rows >= {BLOCK_ROWS}) as sealed_blocks,"
    f" cast(coalesce(sum(rows) filter (where rows >= {BLOCK_ROWS}), 0) as bigint) as sealed_records, cast(0 as bigint) as sorted_blocks, cast(0 as bigint) as sorted_records from {_SIZES}"
)
def block_states(spark, sf_dir):
    return layout.states(*_sharded(spark, sf_dir))


@query(
    _with("ev") + f"select cast(0 as bigint) as active_records, cast(0 as bigint) as sealed_blocks, cast(0 as bigint) as sealed_records,"
    f" count(*) as sorted_blocks, cast(coalesce(sum(rows), 0) as bigint) as sorted_records from {_SIZES}"
)
def block_states_drained(spark, sf_dir):
    return layout.states(*_sharded(spark, sf_dir), drained=True)


@query(
    _with("ev") + f"select pending, greatest(pending - {BACKLOG}, 0) as excess, pending > {BACKLOG} as blocked from (select count(*) filter (where rows >= {BLOCK_ROWS}) as pending from {_SIZES})"
)
def backlog(spark, sf_dir):
    return layout.backlog(*_sharded(spark, sf_dir), BACKLOG)


@query(_with("ev") + f"select shard, block, min(k) as min_key, max(k) as max_key, count(*) as rows from ({_BLOCKS}) group by all")
def block_min_max(spark, sf_dir):
    return layout.zone_map(_blocked(spark, sf_dir))


@query(
    _with("ev") + f"select shard, position, k from (select k % {SHARDS} as shard, row_number() over (partition by k % {SHARDS} order by k, seq) - 1 as position, k from ev) where position % 16 = 0"
)
def sparse_index(spark, sf_dir):
    return layout.sparse_index(events_log(spark, sf_dir), shard_of(F.col("k"), SHARDS))


@query(
    _with("od") + f"select shard, records, keys, live from (select k % {SHARDS} as shard, count(*) as records from od group by 1)"
    f" join (select k % {SHARDS} as shard, count(*) as keys, count(*) filter (where op = 'P') as live from od_new group by 1) using (shard)"
)
def compact_shards(spark, sf_dir):
    return layout.compact_shards(orders_log(spark, sf_dir), shard_of(F.col("k"), SHARDS))


@query(
    "select wanted, cast(case when wanted <= 1 then 1 else pow(2, ceil(log2(wanted))) end as bigint) as shards, cast(greatest(1, wanted * 100 // 116) as bigint) as block_rows,"
    " cast(greatest(1, wanted) as bigint) as workers from range(40) t(wanted)"
)
def normalised_settings(spark, sf_dir):
    settings = [(n, Config(num_shards=n, active_block_size_bytes=100 * n, batch_worker_count=n)) for n in range(40)]
    return spark.createDataFrame([(n, c.shards, c.block_rows, c.workers) for n, c in settings], "wanted bigint, shards bigint, block_rows bigint, workers bigint")


@query("select count(distinct user_id) as keys, cast(0 as bigint) as split_keys, cast(0 as bigint) as out_of_range from events")
def hash_shards(spark, sf_dir):
    """Every key has one shard by hash, and that is among the shards."""
    shards = events_log(spark, sf_dir).groupBy("k").agg(F.min(hash_shard(F.col("k"), SHARDS)).alias("low"), F.max(hash_shard(F.col("k"), SHARDS)).alias("high"))
    return shards.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("low") != F.col("high")).alias("split_keys"), F.count_if((F.col("low") < 0) | (F.col("high") >= SHARDS)).alias("out_of_range"))


@query("select c_custkey as k, rpad(hex(encode(substring(c_name, 1, 8))), 16, '0') as prefix from customer")
def key_prefixes(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), key_prefix(F.col("c_name")).alias("prefix"))


# Counters


_FLUSH = "select count(*) as rows, cast(coalesce(sum(octet_length(encode(cast(k as varchar))) + coalesce(octet_length(encode(v)), 0)), 0) as bigint) as bytes, cast(coalesce(sum(ascii(cast(k as varchar))), 0) as bigint) as checksum from {} where op = 'P'"


@query(_with("od") + _FLUSH.format("od_new"))
def flush_summary(spark, sf_dir):
    return stats.flush_summary(orders_log(spark, sf_dir))


@query(_with("pg") + _FLUSH.format("pg_new"))
def flush_summary_text_keys(spark, sf_dir):
    return stats.flush_summary(pages_log(spark, sf_dir))


@query(
    _with("ev", "od")
    + "select 'events' as log, count(*) as live, count(*) filter (where k not in (select k from ev)) as foreign_keys from ev_new where op = 'P'"
    + " union all select 'orders', count(*), count(*) filter (where k not in (select k from od)) from od_new where op = 'P'"
)
def instance_isolation(spark, sf_dir):
    """Two logs side by side: neither's live view has a key that its own log lacks."""
    out = None
    for name, log in (("events", events_log(spark, sf_dir)), ("orders", orders_log(spark, sf_dir))):
        own = log.select("k").distinct().withColumn("own", F.lit(True))
        row = resolve.live(log).join(own, "k", "left").agg(F.count(F.lit(1)).alias("live"), F.count_if(F.col("own").isNull()).alias("foreign_keys"))
        row = row.select(F.lit(name).alias("log"), "live", "foreign_keys")
        out = row if out is None else out.unionByName(row)
    return out


@query()
def storage_stats(spark, sf_dir):
    return stats.storage_stats(_read(spark, sf_dir, "events"))


@query(
    _with("ev") + "select count(*) as records, count(*) filter (where op = 'D') as tombstones, cast(coalesce(sum(octet_length(encode(cast(k as varchar)))), 0) as bigint) as key_bytes,"
    " cast(coalesce(sum(octet_length(encode(v))), 0) as bigint) as value_bytes from ev"
)
def logical_size(spark, sf_dir):
    return stats.logical_size(events_log(spark, sf_dir))


@query("select count(*) as members, cast(0 as bigint) as rejected from (select distinct user_id from events)")
def bloom_membership(spark, sf_dir):
    """A filter of the log's keys rejects none of them."""
    keys = events_log(spark, sf_dir).select("k").distinct()
    hashes = bloom.hash_count(BLOOM_BITS, BLOOM_KEYS)
    probed = bloom.may_contain(keys, bloom.build(keys, BLOOM_BITS, hashes), BLOOM_BITS, hashes)
    return probed.agg(F.count(F.lit(1)).alias("members"), F.count_if(~F.col("may")).alias("rejected"))


# Stored runs


def _store(spark) -> RunStore:
    return RunStore(spark, scratch_path(spark, "store"))


@query(_with("ev") + "select row_number() over (order by k, seq % 4, seq) as pos, k, seq % 4 as run, seq, op, v from ev")
def merge_stored_runs(spark, sf_dir):
    """The log written in four sorted runs and merged from storage."""
    store = _store(spark)
    store.write_many(events_log(spark, sf_dir), F.col("seq") % 4, 4)
    return resolve.merge_run_rows(store.read())


@query(_with(was=f"select * from ({_LOGS['ev']}) where seq <= {SNAPSHOT}") + "select k, seq, v from was_new where op = 'P'")
def snapshot_stored_runs(spark, sf_dir):
    """A snapshot of the log as it lies in stored runs."""
    store = _store(spark)
    store.write_many(events_log(spark, sf_dir), F.col("seq") % 4, 4)
    return resolve.live(resolve.as_of(store.read(), SNAPSHOT))


def _stored_blocks(spark, sf_dir):
    """The log as it lies in sorted blocks."""
    store = _store(spark)
    blocked = layout.blocks(*_sharded(spark, sf_dir))
    path = store.write_blocks(blocked)
    discard(blocked)
    return store.read_blocks(path, blocked)


@query(_one_sql("7"))
def get_from_blocks(spark, sf_dir):
    """A point read of sorted blocks by shard: one shard's folder is opened, and of its row groups and pages those that may hold the key."""
    key = F.lit(7).cast("bigint")
    blocks = _stored_blocks(spark, sf_dir).where((F.col("shard") == 7 % SHARDS) & (F.col("k") == key))
    return resolve.multi_get(blocks, spark.range(1).select(F.lit(0).cast("bigint").alias("pos"), key.alias("k")))


@query(_with("ev") + f"select shard, block, min(k) as min_key, max(k) as max_key, count(*) as rows from ({_BLOCKS}) group by all")
def stored_block_min_max(spark, sf_dir):
    """The zone map as read back from the sorted files of the blocks."""
    return layout.zone_map(_stored_blocks(spark, sf_dir))


@query(_with("ev") + "select k, seq, v from ev_new where op = 'P'")
def table_lifecycle(spark, sf_dir):
    """The log put through the table: two framed batches, sorted where the table is waited for, compacted and scanned."""
    log = events_log(spark, sf_dir)
    table = MutationTable.create(spark, key_type="bigint", value_type="string", async_background_processing=False, batch_worker_count=4, enable_compaction=True)
    for part in range(2):
        table.apply(log.where(F.col("seq") % 2 == part))
    table.wait_for_background_work()
    return resolve.live(table.log())


# Streaming


@query(ORACLES["compact_latest"])
def stream_upsert(spark, sf_dir):
    """The events file as a stream, run to its end: the same view as the batch query has."""
    schema = _read(spark, sf_dir, "events").schema
    stream = upsert.read_stream(spark, sf_dir, "events.parquet", schema)
    return upsert.upsert_once(log_from(stream, "user_id", "event_id", "props", F.col("event_type") == "error"))
