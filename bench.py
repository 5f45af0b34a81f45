"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads.  Each query runs once
to compile and is then timed to the last row of its result.  The throughput
entries are those of the published figures: logical key and value bytes of a
log, written in sorted runs and then scanned live in key order, per second.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import queries as core
from millrace.functions.records import record_bytes
from millrace.operators import resolve
from millrace.sources.log import log_from
from millrace.sources.storage import RunStore, discard, materialize, remove, scratch_path

HEADLINE = [
    "compact_latest", "latest_with_tombstones", "sorted_scan", "sorted_versions", "merge_runs", "get_point", "multi_get", "multi_get_misses",
    "put_batch_union", "delete_tombstones", "snapshot_as_of", "block_assignment", "block_states_drained", "block_min_max", "compact_shards",
    "bloom_semi_join", "flush_summary", "stream_upsert",
]


#: Times that the lineitem table is written under other keys.
COPIES = 16


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spent(frame) -> float:
    began = time.perf_counter()
    frame().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def logical_mib(log: DataFrame) -> float:
    return log.agg(F.sum(record_bytes(F.col("k"), F.col("v")))).first()[0] / (1 << 20)


def lifecycle(spark: SparkSession, log: DataFrame, runs: int = 4) -> tuple[float, float]:
    """Seconds to write a log in sorted runs, and to scan their live rows in order."""
    store = RunStore(spark, scratch_path(spark, "bench"))
    began = time.perf_counter()
    store.write_many(log, F.col("seq") % runs, runs)
    written = time.perf_counter()
    resolve.live(store.read()).orderBy("k").write.format("noop").mode("overwrite").save()
    done = time.perf_counter()
    remove(spark, store.root)
    return written - began, done - written


def mixed(spark: SparkSession, log: DataFrame, rounds: int = 4) -> float:
    """Seconds to write a log in rounds, each followed by lookups of a quarter as many keys among what is written, all of them found."""
    store = RunStore(spark, scratch_path(spark, "bench"))
    began = time.perf_counter()
    for i in range(rounds):
        part = log.where(F.col("seq") % rounds == i)
        store.add(part)
        asked = part.where(F.floor(F.col("seq") / rounds) % 4 == 0).select(F.col("seq").alias("pos"), "k")
        resolve.multi_get(store.read(), asked).where("found").write.format("noop").mode("overwrite").save()
    spent_on = time.perf_counter() - began
    remove(spark, store.root)
    return spent_on


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    times = {}
    for name in HEADLINE:
        frame = lambda f=core.QUERIES[name]: f(spark, sf_dir)
        spent(frame)
        times[name] = round(spent(frame), 3)
    # The table several times over under other keys, so that fixed costs of jobs weigh little.
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    copies = spark.range(COPIES).select(F.col("id").alias("copy"))
    key = F.concat_ws("-", "copy", "l_orderkey", "l_linenumber")
    source = items.withColumn("payload", F.concat_ws("|", *items.columns)).crossJoin(F.broadcast(copies))
    stored = materialize(log_from(source, key, F.monotonically_increasing_id(), "payload"), "bench-log")
    size = logical_mib(stored)
    lifecycle(spark, stored.limit(100_000))
    write, scan = lifecycle(spark, stored)
    both = mixed(spark, stored)
    discard(stored)
    out = {
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "lifecycle": {"mib": round(size, 2), "write_s": round(write, 3), "scan_s": round(scan, 3), "mib_per_s": round(size / (write + scan), 2)},
        "mixed_80_20": {"mib": round(size, 2), "s": round(both, 3), "mib_per_s": round(size / both, 2)},
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
