"""Length-delimited binary records of token ids, with an offset index.

A shard is a sequence of records, each framed as

    length of the payload    unsigned 64-bit, little-endian
    masked checksum of it    unsigned 32-bit
    payload
    masked checksum of it    unsigned 32-bit

where a checksum is the CRC-32 of the bytes and is masked by a rotation and an
addition, so that checksums of data that holds checksums stay sound.  A payload
is the document's id (signed 64-bit), one byte with the width of a token id (2 or
4) and, in its highest bit, whether the document has no id (it is then zero),
and the token ids in that width.  Beside each shard an index file holds, per
record, its offset in the shard and the number of ids before it in the shard
(two unsigned 64-bit integers), so that a shuffled reader can fetch any record
with one ranged read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_or_empty
from millrace.llm.tokenizing import word_encoder
from millrace.sources.storage import scratch_path

_HEAD, _SUM, _OWN, _ENTRY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qB"), struct.Struct("<QQ")
#: Set in the width's byte if the document has no id.
NAMELESS = 0x80
#: Bytes that a reader asks of the store at a time.
READ = 8 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = _HEAD.pack(len(payload))
    return b"".join((head, _SUM.pack(masked(head)), payload, _SUM.pack(masked(payload))))


def payload_of(doc_id: int | None, ids: bytes) -> bytes:
    """``ids``: packed little-endian unsigned 32-bit integers; kept in two bytes each if all fit."""
    wide = np.frombuffer(ids, "<u4")
    width = 4 if len(wide) and wide.max() > 0xFFFF else 2
    head = _OWN.pack(0, width | NAMELESS) if doc_id is None else _OWN.pack(doc_id, width)
    return head + (ids if width == 4 else wide.astype("<u2").tobytes())


def parse(payload: bytes) -> tuple[int | None, bytes]:
    doc_id, width = _OWN.unpack_from(payload)
    body = payload[_OWN.size :]
    return None if width & NAMELESS else doc_id, body if width & ~NAMELESS == 4 else np.frombuffer(body, "<u2").astype("<u4").tobytes()


def entry(offset: int, before: int) -> bytes:
    """What the index holds on a record."""
    return _ENTRY.pack(offset, before)


class Corrupt(ValueError):
    """A record whose checksums or lengths don't hold."""


def unframe(data: memoryview | bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record that starts at ``at``, and where the next one starts."""
    head = bytes(data[at : at + 8])
    if len(head) < 8 or _SUM.unpack_from(data, at + 8)[0] != masked(head):
        raise Corrupt(f"bad length at {at}")
    n = _HEAD.unpack(head)[0]
    payload = bytes(data[at + 12 : at + 12 + n])
    if len(payload) < n or _SUM.unpack_from(data, at + 12 + n)[0] != masked(payload):
        raise Corrupt(f"bad payload at {at}")
    return payload, at + 16 + n


def stream(source: pa.NativeFile) -> Iterator[bytes]:
    """The payloads of a shard in order, read in pieces of bounded size."""
    held = b""
    while True:
        while len(held) < 12 or len(held) < 16 + _HEAD.unpack_from(held)[0]:
            if len(held) >= 12 and _SUM.unpack_from(held, 8)[0] != masked(held[:8]):
                raise Corrupt("bad length")
            want = READ if len(held) < 12 else max(READ, 16 + _HEAD.unpack_from(held)[0] - len(held))
            more = source.read(want)
            if not more:
                if held:
                    raise Corrupt("the shard ends inside a record")
                return
            held += more
        at = 0
        while len(held) - at >= 12 and len(held) - at >= 16 + _HEAD.unpack_from(held, at)[0]:
            payload, at = unframe(held, at)
            yield payload
        held = held[at:]


def read_at(shard: str, index: str, positions: Iterable[int]) -> Iterator[tuple[int | None, bytes]]:
    """``(doc_id, ids)`` of the records at these positions of a shard, in the order asked for."""
    store, path = fs.FileSystem.from_uri(shard)
    entries_store, entries_path = fs.FileSystem.from_uri(index)
    with store.open_input_file(path) as data, entries_store.open_input_file(entries_path) as entries:
        size = data.size()
        for k in positions:
            pair = entries.read_at(2 * _ENTRY.size, k * _ENTRY.size)
            begin = _ENTRY.unpack_from(pair)[0]
            end = _ENTRY.unpack_from(pair, _ENTRY.size)[0] if len(pair) == 2 * _ENTRY.size else size
            yield parse(unframe(data.read_at(end - begin, begin))[0])


MANIFEST = "shard int, records bigint, tokens bigint, data string, entries string"


def write_records(
    docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 2, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> list[dict]:
    """Encode ``docs`` and write them in ascending order of id; returns the manifest, a row per shard.

    Rows are dealt over the shards by ranges of (id, hash of the text) and
    sorted in each, so that one id on many rows is no load on one task; rows
    that agree in both are adjacent in any order.  Rows without an id come
    first and are framed as such.  Null and empty texts are the end id alone;
    a text of any length is one record, written whole.  Other columns are
    ignored; an empty table gives an empty manifest.  Each attempt of a task writes files of its own name and the
    manifest names those of the attempt that counted, so lost executors leave
    at most files that nothing refers to.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "records")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        records = tokens = at = 0
        data = entries = None
        for batch in batches:
            if batch.num_rows and data is None:
                store.create_dir(root, recursive=True)
                data, entries = store.open_output_stream(f"{root}/{name}.rec"), store.open_output_stream(f"{root}/{name}.idx")
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                ids += end
                record = frame(payload_of(doc_id, ids))
                entries.write(entry(at, tokens))
                data.write(record)
                records, tokens, at = records + 1, tokens + len(ids) // 4, at + len(record)
        if data is not None:
            data.close()
            entries.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "records": records, "tokens": tokens, "data": f"{folder}/{name}.rec", "entries": f"{folder}/{name}.idx"}], manifest_schema)

    manifest_schema = pa.schema([("shard", pa.int32()), ("records", pa.int64()), ("tokens", pa.int64()), ("data", pa.string()), ("entries", pa.string())])
    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shards, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    # The manifest has as many rows as there are shards.
    rows = [r.asDict() for r in ordered.mapInArrow(run, MANIFEST).collect()]
    return sorted(rows, key=lambda r: r["shard"])


def read_records(spark, manifest: list[dict]) -> DataFrame:
    """``(shard, doc_id, start, ids)`` of all records, read back from the files of the manifest.

    ``start`` is the number of ids of all records before it, over all shards.
    Every checksum is verified and every count compared with the manifest.
    """
    rows, before = [], 0
    for r in manifest:
        rows.append((r["shard"], r["records"], r["tokens"], r["data"], before))
        before += r["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for shard in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(shard["data"])
                start, out, held, n = shard["before"], [], 0, 0
                with store.open_input_stream(path) as source:
                    for payload in stream(source):
                        doc_id, ids = parse(payload)
                        out.append({"shard": shard["shard"], "doc_id": doc_id, "start": start, "ids": ids})
                        start, held, n = start + len(ids) // 4, held + len(ids), n + 1
                        if held > READ:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
                if n != shard["records"] or start - shard["before"] != shard["tokens"]:
                    raise Corrupt(f"{path}: {n} records, the manifest has {shard['records']}")
                yield pa.RecordBatch.from_pylist(out, schema)

    listed = spark.createDataFrame(rows, "shard int, records bigint, tokens bigint, data string, before bigint")
    return listed.repartition(max(1, len(rows))).mapInArrow(run, "shard int, doc_id bigint, start bigint, ids binary")
