"""Runs of a log as Parquet files, and frames that outlive executors."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    A temporary folder of this machine serves only where the session names
    none and everything runs in one process; elsewhere executors would each
    write to a disk of their own, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/millrace/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, so a lost executor
    costs the tasks it was running and nothing more.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _store(spark, path)
    fs.delete(target, True)


def discard(*frames: DataFrame) -> None:
    """Delete the files behind materialized frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_millrace_path", None)
        if path:
            remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs deleted now: Spark does so once the driver has collected what refers to them."""
    spark._jvm.System.gc()


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written in here are deleted as each job ends, whenever the driver collects its memory."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


class Scratch:
    """Materializes the steps of an operator and deletes them once its result is written."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        self.frames.append(materialize(df, label))
        return self.frames[-1]

    def own(self, df: DataFrame) -> DataFrame:
        """Take over a frame that is materialized already."""
        self.frames.append(df)
        return df

    def clear(self) -> None:
        discard(*self.frames)
        self.frames = []


def _store(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def by_key(log: DataFrame) -> DataFrame:
    """The order of a run's rows: by key, versions by sequence, of blocks one after the other."""
    placed = [c for c in ("shard", "block") if c in log.columns]
    return log.sortWithinPartitions(*placed, "k", "seq")


#: What orders the rows of each task that writes a run.
Sorter = Callable[[DataFrame], DataFrame]
#: Columns of a run's rows.
ROWS = ["k", "seq", "op", "v"]


class Run(NamedTuple):
    """A run by name; one that isn't sorted waits for it."""

    name: str
    sorted: bool = True


class RunStore:
    """Immutable runs under a root, with a manifest that names those in force.

    A run is written under a new name and comes in force when the manifest,
    itself a new small file that appears whole or not at all, names it;
    nothing that is being read is ever overwritten, so every reader has a
    snapshot.  Of two writers that commit at once the later one starts again
    from the other's manifest.
    """

    def __init__(self, spark: SparkSession, root: str, sorter: Sorter = by_key) -> None:
        self.spark, self.root, self.sorter = spark, root.rstrip("/"), sorter

    def manifests(self) -> list[str]:
        fs, path = _store(self.spark, f"{self.root}/manifests")
        return sorted(n for s in fs.listStatus(path) if (n := s.getPath().getName()).endswith(".json")) if fs.exists(path) else []

    def entries(self) -> list[Run]:
        """The runs in force, oldest first."""
        found = self.manifests()
        if not found:
            return []
        fs, path = _store(self.spark, f"{self.root}/manifests/{found[-1]}")
        held = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
        finally:
            held.close()
        return [Run(*r) for r in json.loads(text)["runs"]]

    def runs(self) -> list[str]:
        return [r.name for r in self.entries()]

    def commit(self, change: Callable[[list[Run]], list[Run]], tries: int = 100) -> None:
        """Put ``change`` of the runs in force in force."""
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        for _ in range(tries):
            # The number is taken before the runs are read, so a commit in between makes this one fail.
            number = len(self.manifests())
            runs = change(self.entries())
            fs, draft = _store(self.spark, f"{self.root}/manifests/_{uuid.uuid4().hex}")
            out = fs.create(draft, False)
            out.write(bytearray(json.dumps({"runs": runs}).encode()))
            out.close()
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
            try:
                context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests/{number:08d}.json"), none)
                return
            except Py4JJavaError as error:
                fs.delete(draft, False)
                if "FileAlreadyExists" not in str(error.java_exception):
                    raise
        raise RuntimeError("other writers kept committing")

    def add(self, log: DataFrame, partitions: int | None = None, name: str | None = None) -> str:
        """Write a log as one sorted run and put it in force as the newest.  A run of a name that is in force is left as it is."""
        if name is not None and name in self.runs():
            return name
        written = self.write(log, partitions, name)
        self.commit(lambda runs: runs if written in [r.name for r in runs] else [*runs, Run(written)])
        return written

    def append(self, log: DataFrame, partitions: int | None = None) -> str:
        """Write a log as it comes and put it in force as a run that waits to be sorted."""
        name = f"run-{uuid.uuid4().hex}"
        (log.coalesce(partitions) if partitions else log).select(*ROWS).write.parquet(f"{self.root}/runs/{name}")
        self.commit(lambda runs: [*runs, Run(name, False)])
        return name

    def pending(self) -> list[str]:
        return [r.name for r in self.entries() if not r.sorted]

    def sort(self, name: str) -> None:
        """Put a sorted copy in the place of a run that waits for it."""
        done = self.write(self.spark.read.parquet(f"{self.root}/runs/{name}"))
        self.commit(lambda runs: [Run(done) if r.name == name else r for r in runs])

    def replace(self, old: list[str], new: str) -> None:
        """Put one run in the place of neighbours that it merges."""
        self.commit(lambda runs: [Run(new) if r.name == old[0] else r for r in runs if r.name not in old[1:]])

    def _put(self, ordered: DataFrame, path: str, folders: list[str]) -> None:
        # Row-group statistics let a point read skip what can't hold the key; the Bloom filter skips what could but doesn't.
        ordered.write.mode("overwrite").option("parquet.bloom.filter.enabled#k", "true").option("parquet.bloom.filter.expected.ndv#k", "1000000").partitionBy(*folders).parquet(path)

    def write(self, log: DataFrame, partitions: int | None = None, name: str | None = None) -> str:
        """A run in ranges of keys, each of them sorted."""
        name = name or f"run-{uuid.uuid4().hex}"
        rows = log.select(*ROWS)
        ranged = rows.repartitionByRange(partitions, "k", "seq") if partitions else rows.repartitionByRange("k", "seq")
        self._put(self.sorter(ranged), f"{self.root}/runs/{name}", [])
        return name

    def write_many(self, log: DataFrame, number: Column, count: int) -> list[str]:
        """``count`` runs of one log in one job, a row going to the run of its ``number`` from 0; oldest first."""
        group = f"run-{uuid.uuid4().hex}"
        ranged = log.select(*ROWS, number.cast("int").alias("part")).repartitionByRange("part", "k", "seq")
        self._put(ranged.sortWithinPartitions("part", "k", "seq"), f"{self.root}/runs/{group}", ["part"])
        there = {s.getPath().getName() for s in self._list(f"{self.root}/runs/{group}")}
        names = [f"{group}/part={i}" for i in range(count) if f"part={i}" in there]
        self.commit(lambda runs: [*runs, *(Run(n) for n in names)])
        return names

    def write_blocks(self, blocked: DataFrame) -> str:
        """The blocks of a log with ``shard`` and ``block``, a folder for each shard; reads that know the shard open no other's files.

        A file holds whole blocks, one sorted block after the other, as many
        as a task has of the shard.  Files of their own would cost each block,
        however small, two entries on the disk and a footer.
        """
        name = f"blocks-{uuid.uuid4().hex}"
        dealt = blocked.select(*ROWS, "shard", "block").repartitionByRange("shard", "block")
        with dropping_shuffles(self.spark):
            self._put(self.sorter(dealt), f"{self.root}/{name}", ["shard"])
        return f"{self.root}/{name}"

    def read_blocks(self, path: str, blocked: DataFrame) -> DataFrame:
        """What ``write_blocks`` put there of ``blocked``, which may have no rows."""
        return self.spark.read.schema(blocked.select(*ROWS, "shard", "block").schema).parquet(path)

    def _list(self, path: str) -> list:
        fs, target = _store(self.spark, path)
        return list(fs.listStatus(target))

    def read(self, runs: list[str] | None = None) -> DataFrame | None:
        """All rows of the runs with ``run``, their place in the order of age; one scan, however many runs there are."""
        names = self.runs() if runs is None else runs
        if not names:
            return None
        ages = F.create_map(*(F.lit(x) for age, name in enumerate(names) for x in (name, age)))
        found = self.spark.read.parquet(*(f"{self.root}/runs/{n}" for n in names))
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/runs/(run-[^/]+(?:/part=\d+)?)/[^/]*$", 1)
        return found.select(*ROWS, F.element_at(ages, name).cast("bigint").alias("run"))
