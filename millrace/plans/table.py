"""A table facade over a mutation log, with the write, read and lifecycle calls of a versioned store."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.functions.records import MAX_RECORD_BYTES, hash_shard
from millrace.operators import resolve, stats
from millrace.plans import layout
from millrace.sources.log import COLUMNS, DELETE, PUT, checked
from millrace.sources.storage import RunStore, Sorter, by_key, scratch_path


@dataclass(frozen=True)
class Config:
    """Settings as given; the properties are the normalised ones in force.

    ``batch_worker_count`` tasks write a batch; sealed blocks are sorted by a
    thread beside the writer if ``async_background_processing`` holds, and
    else where the table is waited for.
    """

    active_block_size_bytes: int = 786_432
    enable_compaction: bool = False
    num_shards: int = 16
    batch_worker_count: int = 1
    async_background_processing: bool = True
    max_record_bytes: int | None = MAX_RECORD_BYTES

    @property
    def block_rows(self) -> int:
        return layout.block_rows(self.active_block_size_bytes)

    @property
    def shards(self) -> int:
        return layout.shard_count(self.num_shards)

    @property
    def workers(self) -> int:
        return max(1, self.batch_worker_count)


def _size(x) -> int:
    return len(x.encode() if isinstance(x, str) else x if isinstance(x, (bytes, bytearray)) else str(x).encode())


class MutationTable:
    """Puts, deletes and batches in the order of their calls; the newest write of a key wins.

    Small writes gather on the driver up to a block and then are sealed: they
    become a run on shared storage that waits to be sorted; batches given as
    frames are sealed at once.  Reads see every write made before them.  Each
    table has runs of its own, in the order of ``sorter``.
    """

    def __init__(self, spark: SparkSession, config: Config = Config(), root: str | None = None, key_type: str = "binary", value_type: str = "binary", sorter: Sorter = by_key) -> None:
        self.spark, self.config = spark, config
        self.schema = f"k {key_type}, seq bigint, op string, v {value_type}"
        self.store = RunStore(spark, root or scratch_path(spark, "table"), sorter)
        # One thread, so that runs are sorted in the order of their sealing.
        self.background = ThreadPoolExecutor(1) if config.async_background_processing else None
        self.waiting: list[Future] = []
        self.active: list[tuple] = []
        self.next_seq = 1 + max((r[0] or 0 for r in [self._stored().agg(F.max("seq")).first()]), default=0)

    @classmethod
    def create(cls, spark: SparkSession, root: str | None = None, key_type: str = "binary", value_type: str = "binary", sorter: Sorter = by_key, **settings) -> MutationTable:
        return cls(spark, Config(**settings), root, key_type, value_type, sorter)

    # Writes

    def put(self, key, value) -> None:
        self._append([(key, PUT, value)])

    def delete(self, key) -> None:
        """Hide a key; one that doesn't exist stays absent."""
        self._append([(key, DELETE, None)])

    def put_batch(self, batch: DataFrame | Iterable[tuple], ordinal: str | None = None) -> None:
        """Put pairs in their order, all or none.

        A frame has ``k`` and ``v`` and an ``ordinal`` column of whole numbers
        from 0, since rows of a frame have no order of their own.
        """
        if not isinstance(batch, DataFrame):
            self._append([(k, PUT, v) for k, v in batch])
            return
        if ordinal is None:
            raise ValueError("a frame needs an ordinal column that says the order of its puts")
        self.seal()
        last = batch.agg(F.max(ordinal)).first()[0]
        if last is not None:
            rows = batch.select("k", (F.col(ordinal) + self.next_seq).cast("bigint").alias("seq"), F.lit(PUT).alias("op"), "v")
            self._queue(checked(rows, self.config.max_record_bytes).repartition(self.config.workers))
            self.next_seq += last + 1

    def apply(self, log: DataFrame) -> None:
        """Take the writes of a log, puts and deletes, with the sequence numbers that they carry."""
        self.seal()
        last = log.agg(F.max("seq")).first()[0]
        if last is not None:
            self._queue(checked(log.select(*COLUMNS), self.config.max_record_bytes).repartition(self.config.workers))
            self.next_seq = max(self.next_seq, last + 1)

    def _append(self, rows: list[tuple]) -> None:
        limit = self.config.max_record_bytes
        for key, _, value in rows:
            if key is None:
                raise ValueError("a key is null")
            if limit is not None and _size(key) + (0 if value is None else _size(value)) > limit:
                raise ValueError(f"a record has over {limit} bytes")
        for key, op, value in rows:
            self.active.append((key, self.next_seq, op, value))
            self.next_seq += 1
        if len(self.active) >= self.config.block_rows * self.config.shards:
            self.seal()

    # Reads

    def _stored(self) -> DataFrame:
        runs = self.store.read()
        return self.spark.createDataFrame([], self.schema) if runs is None else runs.select(*COLUMNS)

    def log(self) -> DataFrame:
        """Every write that is still kept."""
        stored = self._stored()
        return stored.unionByName(self.spark.createDataFrame(self.active, self.schema)) if self.active else stored

    def lookup(self, key) -> tuple[bool, object]:
        """Whether the key is there and its value, in one read; a stored null is there."""
        row = resolve.get(self.log(), F.lit(key)).first()
        return (False, None) if row is None else (True, row["v"])

    def get(self, key):
        """The value, or None if the key is absent or deleted; ``lookup`` tells a stored null from that."""
        return self.lookup(key)[1]

    def found(self, key) -> bool:
        return self.lookup(key)[0]

    def multi_get(self, keys: list) -> list:
        """One result for each key given, in order."""
        if not keys:
            return []
        asked = self.spark.createDataFrame(list(enumerate(keys)), f"pos bigint, {self.schema.split(',')[0]}")
        return [r["v"] for r in sorted(resolve.multi_get(self.log(), asked).collect(), key=lambda r: r["pos"])]

    def scan(self) -> DataFrame:
        """``(k, v)`` of the live keys in order."""
        self.wait_for_background_work()
        return resolve.live(self.log()).orderBy("k").select("k", "v")

    def iterate(self) -> Iterator[Row]:
        """The scan, pulled partition by partition."""
        return self.scan().toLocalIterator()

    # Lifecycle

    def seal(self) -> None:
        """Turn the writes gathered so far into a run that waits to be sorted."""
        if self.active:
            rows, self.active = self.active, []
            self._queue(self.spark.createDataFrame(rows, self.schema).coalesce(1))

    def _queue(self, log: DataFrame) -> None:
        name = self.store.append(log)
        if self.background is not None:
            self.waiting.append(self.background.submit(self.store.sort, name))

    def pending(self) -> int:
        """Sealed runs that aren't sorted."""
        return len(self.store.pending())

    def wait_for_background_work(self) -> None:
        """Seal the open block too and wait until all is sorted."""
        self.seal()
        self.wait_for_pending_background_work()

    def wait_for_pending_background_work(self) -> None:
        """Wait until what is sealed is sorted, and compacted if the table does so; the open block stays open."""
        self.wait_for_background_backlog_at_most(0)
        if self.config.enable_compaction:
            self.compact()

    def wait_for_background_backlog_at_most(self, runs: int) -> None:
        """Hold the writer until at most so many sealed runs wait to be sorted."""
        if self.background is not None:
            while len(self.waiting) > runs:
                self.waiting.pop(0).result()
        # Without a thread the work is done here, as is what an earlier table over these runs left.
        for name in self.store.pending()[: max(0, self.pending() - runs)]:
            self.store.sort(name)

    def compact(self) -> None:
        """Merge all runs into one without superseded writes; as it is the whole history, tombstones go too."""
        self.wait_for_background_backlog_at_most(0)
        self.compact_newest(len(self.store.runs()))

    def compact_newest(self, runs: int) -> None:
        """Merge the newest runs only; tombstones stay, for they hide keys of older runs."""
        self.wait_for_background_backlog_at_most(0)
        names = self.store.runs()
        if runs > 1 and len(names) >= runs:
            merged = layout.compact_run(self.store.read(names[-runs:]).select(*COLUMNS), whole_history=runs == len(names))
            self.store.replace(names[-runs:], self.store.write(merged))

    def close(self) -> None:
        """Seal what is open, wait for the background and stop it."""
        self.wait_for_background_work()
        if self.background is not None:
            self.background.shutdown()
            self.background = None

    # Counters

    def states(self, drained: bool = False) -> Row:
        return layout.states(self.log(), hash_shard(F.col("k"), self.config.shards), self.config.block_rows, drained).first()

    def flush_summary(self) -> Row:
        return stats.flush_summary(self.log()).first()

    def storage(self) -> Row:
        """Files of the runs in force and their size."""
        names = self.store.runs()
        if not names:
            return Row(files=0, size_bytes=0)
        return stats.storage_stats(self.spark.read.parquet(*(f"{self.store.root}/runs/{n}" for n in names))).first()
