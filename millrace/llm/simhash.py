"""SimHash near-duplicate detection over a byte-position inverted index.

A fingerprint has eight bytes.  Two fingerprints that differ in at most ``d``
bits agree in at least ``8 - d`` byte positions.  Distinct fingerprints are
posted under 14 groups of four byte positions: the fours whose numbers, as
three bits each, cancel out.  Any three positions lie in exactly one of them, so
fingerprints that agree in eight, seven or six positions share exactly 14,
seven or three groups, and those that agree in fewer share one or none.  The
shared groups of each pair that meets in the index are tallied, pairs under the
guaranteed minimum are dropped, and the rest is verified bit by bit.

Looser copies, down to a Jaccard similarity of 0.8, differ in too many of 64
bits for that.  They are sought by wide fingerprints of 64 bytes, posted under
192 groups of three byte positions of which no two share two positions; what
meets in a list is tested bit by bit, and then by its exact shingle sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_or_empty
from millrace.llm.graph import connected_components
from millrace.llm.line_dedup import links
from millrace.sources.storage import Scratch, discard, materialize

SEED = 42
BYTES = 8
GROUPS = [g for g in combinations(range(BYTES), 4) if g[0] ^ g[1] ^ g[2] ^ g[3] == 0]
#: Groups that fingerprints of so many differing bits share at least.
SHARED = {0: 14, 1: 7, 2: 3}
#: Posting lists longer than this are split by further byte positions; no row is lost.
LONG_LIST = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 16
#: 64-bit parts of a wide fingerprint; its groups of byte positions are these, moved along by up to all 64 positions (no
#: difference of two positions comes twice); differing bits up to which two may be copies.  At a similarity of 0.8 about
#: 78 of the 512 bits differ, give or take 8, and 256 of unlike texts.
PARTS, MOVED, NEAR_BITS = 8, ((0, 1, 3), (0, 4, 9), (0, 6, 13)), 160
_PARTS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, (3, PARTS), np.uint64) * np.uint64(2) + np.uint64(1)
#: Bands of a text's MinHash signature and hashes of a band, by which pairs that wide fingerprints miss are found: texts of similarity 0.8 share a band with probability 0.9998.
COPY_BANDS, COPY_ROWS = 16, 4
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, COPY_BANDS * COPY_ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles as an unsigned integer.

    Without a word it is 0; with fewer words than a shingle the whole sequence
    is the one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : min(at + _CHUNK, n) + shingle - 1]
        runs = [part[i:] for i in range(min(shingle, len(words)))]
        hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*runs)), np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)``: the SimHash of every row as a signed long; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(x, shingle) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())], ["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def _byte(i: int, column: str = "fp") -> Column:
    return F.shiftrightunsigned(F.col(column), 8 * i).bitwiseAND(F.lit(255))


def _key(positions: tuple[int, ...]) -> Column:
    """The bytes at the positions, in one long."""
    key = F.lit(0).cast("bigint")
    for i in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(i))
    return key


def tallied_pairs(prints: DataFrame, keep: Scratch) -> DataFrame:
    """``(fp_a, fp_b, tally)``: the groups of byte positions that two fingerprints share, for all pairs that agree in six positions or more.

    ``prints`` has one row ``fp`` per distinct fingerprint.  A posting list
    longer than ``LONG_LIST`` is split by each two of the four positions that
    its group leaves free, so that its members meet under six equal bytes;
    pairs that agree in fewer may then be missing or have a lower tally.
    """
    postings = keep(
        prints.select(
            "fp",
            F.explode(F.array(*(F.struct(F.lit(g).alias("g"), _key(at).alias("key")) for g, at in enumerate(GROUPS)))).alias("p"),
        ).select("fp", "p.*"),
        "postings",
    )
    lists = keep(postings.groupBy("g", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists")
    shared = postings.join(lists, ["g", "key"])
    short = shared.where(F.col("n") <= LONG_LIST).select("fp", "g", "key", F.lit(-1).alias("h"), F.lit(0).cast("bigint").alias("more"))
    finer = F.lit(None)
    for g, at in enumerate(GROUPS):
        free = [i for i in range(BYTES) if i not in at]
        choice = F.array(*(F.struct(F.lit(h).alias("h"), _key(two).alias("more")) for h, two in enumerate(combinations(free, 2))))
        finer = F.when(F.col("g") == g, choice).otherwise(finer)
    long = shared.where(F.col("n") > LONG_LIST).select("fp", "g", "key", F.explode(finer).alias("f")).select("fp", "g", "key", "f.*")
    index = keep(short.unionByName(long), "index")
    on = ["g", "key", "h", "more"]
    met = index.withColumnRenamed("fp", "fp_a").join(index.withColumnRenamed("fp", "fp_b"), on).where("fp_a < fp_b")
    # A pair of a long list may meet under several choices of two positions, which are one group.
    return met.select("fp_a", "fp_b", "g").distinct().groupBy("fp_a", "fp_b").agg(F.count(F.lit(1)).alias("tally"))


def near_pairs(prints: DataFrame, max_bits: int = 2, least: int | None = None) -> DataFrame:
    """``(fp_a, fp_b)`` with ``fp_a < fp_b`` for all distinct fingerprints within ``max_bits``.

    Of the tallied pairs those of ``least`` shared groups (the guaranteed
    minimum, unless given) or more are verified.  The result is materialized.
    """
    if max_bits not in SHARED:
        raise ValueError("the groups guarantee a tally up to two bits")
    keep = Scratch()
    candidates = tallied_pairs(prints, keep).where(F.col("tally") >= (SHARED[max_bits] if least is None else least))
    out = materialize(candidates.where(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= max_bits).select("fp_a", "fp_b"), "near")
    keep.clear()
    return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most
    ``max_bits`` differing bits, the row's own included.  Equal fingerprints
    are one node, so a group of copies of any size costs one posting.  Null
    and empty texts have the fingerprint zero and are linked like any other.
    A row without an id has a fingerprint but no say in ``component_id``,
    which is null if nothing with an id is in reach.  Repeated rows are
    repeated in the result; texts of any length are read whole, in parts of
    bounded size; other columns are ignored; an empty table has no rows.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    near = near_pairs(nodes.select("fp"), max_bits)
    linked = connected_components(near, "fp_a", "fp_b")
    roots = materialize(nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "roots")
    lowest = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = materialize(roots.join(lowest, "root").select("fp", "component_id"), "classes")
    discard(nodes, near, linked, roots)
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id.

    Rows that share an id are one document, of which one row stays.  Rows
    without an id belong to no group and stay.
    """
    members = materialize(simhash_components(docs.where(F.col(id_col).isNotNull()), id_col, text_col, shingle, max_bits), "members")
    return _keep_first(docs, members, id_col)


def _keep_first(docs: DataFrame, members: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without those whose ``component_id`` in ``members`` is another's id."""
    ids = members.groupBy(id_col).agg(F.count(F.lit(1)).alias("rows"), F.min("component_id").alias("low"))
    # Those that go are mostly fewer than those that stay, so they are what meets the texts.
    ids = materialize(ids.select(id_col, "rows", (F.col("low") == F.col(id_col)).alias("stays")), "keepers")
    discard(members)
    single = docs.where(F.col(id_col).isNotNull()).join(ids.where("not stays or rows > 1"), id_col, "left_anti")
    repeated = docs.join(ids.where("stays and rows > 1"), id_col, "left_semi").dropDuplicates([id_col])
    return single.unionByName(repeated).unionByName(docs.where(F.col(id_col).isNull()))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Distinct hashes of the word shingles; fewer words than a shingle are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n))


def copy_buckets(hashes: np.ndarray) -> list[int]:
    """A bucket for each band of the MinHash signature, as signed longs."""
    if not len(hashes):
        return []
    least = np.min([((hashes[at : at + 4096, None] ^ _MIX[0]) * _MIX[1]).min(0) for at in range(0, len(hashes), 4096)], axis=0)
    digests = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(COPY_BANDS, COPY_ROWS))]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """The SimHash of 512 bits of a set of shingle hashes; no shingles have none."""
    ones = np.zeros(64 * PARTS, np.int64)
    for at in range(0, len(hashes), 255):
        mixed = (hashes[at : at + 255, None] ^ _PARTS[0]) * _PARTS[1]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _PARTS[2]
        # 255 bits at most add up in a byte.
        ones += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes() if len(hashes) else b""


def wide_postings(nodes: DataFrame) -> DataFrame:
    """``(lid, bucket)``: a row for each group of byte positions of ``print``, by its bytes."""
    ring = F.concat("print", F.substring("print", 1, max(map(max, MOVED))))
    key = lambda g: lambda i: F.xxhash64(F.lit(g), i, *(F.substring(F.col("ring"), i + 1 + d, F.lit(1)) for d in MOVED[g]))
    lists = [F.transform(F.sequence(F.lit(0), F.lit(8 * PARTS - 1)), key(g)) for g in range(len(MOVED))]
    return nodes.where(F.length("print") > 0).select("lid", ring.alias("ring")).select("lid", F.explode(F.concat(*lists)).alias("bucket"))


def wide_candidates(nodes: DataFrame, keep: Scratch) -> DataFrame:
    """``(lid, bucket)`` of the fingerprints ``(lid, print, words)`` that have another within ``NEAR_BITS`` in a list.

    In lists of over ``LONG_LIST`` all are taken to have one; no pair within
    ``NEAR_BITS`` that meets in a list is lost.
    """
    dealt = wide_postings(nodes).repartition("bucket")
    shared = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keep(dealt.join(shared.hint("shuffle_hash"), "bucket").select("bucket", "lid", "n"), "postings")
    short = met.where(F.col("n") <= LONG_LIST).join(nodes.select("lid", "words"), "lid")
    members = short.groupBy("bucket").agg(F.collect_list(F.struct("lid", "words")).alias("all"))
    differ = lambda a, b: sum((F.bit_count(a["words"][k].bitwiseXOR(b["words"][k])) for k in range(PARTS)), F.lit(0))
    near = F.filter("all", lambda a: F.exists("all", lambda b: (a["lid"] != b["lid"]) & (differ(a, b) <= NEAR_BITS)))
    tested = members.select("bucket", F.explode(near).alias("m")).select("m.lid", "bucket")
    return tested.unionByName(met.where(F.col("n") > LONG_LIST).select("lid", "bucket"))


def shingle_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group linked by a Jaccard similarity of word shingles.

    Two bits of a 64-bit SimHash stand for far closer copies, so candidates come
    from the byte positions of SimHashes of 512 bits, and MinHash bands add those
    that few bytes of two fingerprints agree in; each is verified by its exact
    shingle sets.  Texts of the same words are one node, texts without words too;
    two that only share its 64-bit name are left alone.  Rows that share an id are
    one document, rows without an id stay.
    """
    named = docs.where(F.col(id_col).isNotNull())
    source = named.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches):
        for batch in batches:
            names, proofs, prints, buckets = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = _words(text)
                whole = b" ".join(words)
                names.append(xxhash.xxh64_intdigest(whole, SEED))
                proofs.append(xxhash.xxh64_intdigest(whole, SEED + 1))
                hashes = shingle_hashes(words, shingle)
                prints.append(wide_fingerprint(hashes))
                buckets.append(copy_buckets(hashes))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (names, proofs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(prints, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], ["id", "lid", "proof", "print", "buckets"])

    def gather(batches):
        for batch in batches:
            names, sets = [], []
            for text in batch.column(1).to_pylist():
                words = _words(text)
                names.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
                sets.append(shingle_hashes(words, shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.uint64).view(np.int64), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["lid", "line"])

    rows = materialize(source.mapInArrow(sign, f"id {kind}, lid bigint, proof bigint, print binary, buckets array<bigint>"), "signed")
    nodes = rows.groupBy("lid").agg(F.min("id").alias("low"), F.min("proof").alias("p0"), F.max("proof").alias("p1"), F.min("print").alias("print"), F.min("buckets").alias("buckets"))
    part = lambda k: F.conv(F.hex(F.substring("print", 8 * k + 1, 8)), 16, -10).cast("bigint")
    nodes = materialize(nodes.where("p0 = p1").select("lid", "low", "print", "buckets"), "nodes")
    every = nodes.select("lid", F.explode("buckets").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    keep = Scratch()
    wide = wide_candidates(nodes.select("lid", "print", F.array(*(part(k) for k in range(PARTS))).alias("words")), keep)
    found = wide.unionByName(every.join(shared, "bucket", "left_semi").select("lid", "bucket"))
    met = materialize(found.join(nodes.select("lid", "low"), "lid"), "met")
    keep.clear()
    # Only texts that meet another have their shingles written out.
    asked = source.join(met.select(F.col("low").alias("id")).distinct(), "id", "left_semi")
    sets = asked.mapInArrow(gather, "lid bigint, line array<bigint>").join(met.select("lid").distinct(), "lid", "left_semi").dropDuplicates(["lid"])
    sets = materialize(sets, "sets")
    linked = links(sets, similarity, met.select("lid", "bucket"), lambda x: x, lambda df: df.select("lid", F.explode("line").alias("s")))
    roots = materialize(nodes.select("lid", "low").join(linked.withColumnRenamed("node", "lid"), "lid", "left").select("lid", "low", F.coalesce("root", "lid").alias("root")), "roots")
    lowest = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = roots.join(lowest, "root").select("lid", "component_id")
    members = rows.select("id", "lid").join(classes, "lid", "left").select(F.col("id").alias(id_col), F.coalesce("component_id", "id").alias("component_id"))
    members = materialize(members, "members")
    discard(rows, nodes, met, sets, linked, roots)
    return _keep_first(docs, members, id_col)
