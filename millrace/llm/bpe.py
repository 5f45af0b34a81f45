"""Byte-level BPE by corpus-level merge replay.

Encoding doesn't walk each word on its own.  The distinct words of a block of
the corpus lie end to end in sequences of bytes; an inverted index leads from
each pair of adjacent tokens to its positions.  The merges are replayed in rank
order: the pair of least rank is applied at all its positions, which changes
the pairs with its neighbours and nothing else.  Tokens never cross a word, so
blocks of any cut give what one pass over the whole corpus would give, and a
task needs no more memory than its block's distinct words take.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_or_empty
from millrace.llm.tokenizing import BYTE_LEVEL, UNSURE, WordCache, plain_pattern

#: Characters of text whose distinct words are replayed together (a longer text is a block of its own), texts taken
#: from Arrow at a time, and words kept between blocks.
BLOCK, TEXTS, CACHED = 3 << 20, 512, 5 << 17
#: Bytes of distinct words that are replayed at once, so that a block of new words needs no more memory than a later one
#: (a longer word is replayed whole), and pairs of tokens whose rank a worker keeps.
REPLAYED, PAIRS = 1 << 17, 1 << 19


_ID = struct.Struct("<I")


class Ranks:
    """A vocabulary of byte strings by rank."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {b: a for a, b in self.rank.items()}
        self.bytes = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.words = regex.compile(pattern).findall
        self.plain = plain_pattern(pattern).findall if pattern == BYTE_LEVEL else None
        self.pairs: dict[int, int] = {}
        self.known = WordCache(CACHED)

    def merged(self, pair: int) -> int:
        """The rank of two tokens (in one integer) put together, or -1."""
        got = self.pairs.get(pair)
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[pair] = self.rank.get(self.token[pair >> 32] + self.token[pair & 0xFFFFFFFF], -1)
        return got

    def split(self, text: str) -> list[str]:
        return self.plain(text) if self.plain and not UNSURE.search(text) else self.words(text)


@lru_cache(maxsize=4)
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def replay(words: list[bytes], vocabulary: Ranks) -> list[bytes]:
    """The packed ids of each distinct word, by replaying all merges over all words at once."""
    whole = vocabulary.rank
    done: dict[int, bytes] = {}
    rest = []
    for k, word in enumerate(words):
        if word in whole:
            done[k] = _ID.pack(whole[word])
        elif word:
            rest.append(k)
        else:
            done[k] = b""
    lengths = np.array([len(words[k]) for k in rest], np.int64)
    ends = np.cumsum(lengths)
    # Tokens by position; -1 where a token was merged into the one before it.
    start_ids = vocabulary.bytes[np.frombuffer(b"".join(words[k] for k in rest), np.uint8)]
    ids = start_ids.tolist()
    n = len(ids)
    marks = np.zeros((2, n), np.uint8)
    marks[0, ends - lengths] = 1
    marks[1, ends - 1] = 1
    first, last = bytearray(marks[0].tobytes()), bytearray(marks[1].tobytes())
    follows = list(range(1, n + 1))
    leads = list(range(-1, n - 1))
    # The inverted index: positions of the left token by the rank that the pair merges to.  Several
    # pairs can make one token, so the pair is part of the key.
    index: dict[tuple[int, int], list[int]] = {}
    merged = vocabulary.merged
    places = np.nonzero(marks[1, : n - 1] == 0)[0] if n else np.zeros(0, np.int64)
    pairs = start_ids[places] << 32 | start_ids[places + 1]
    order = np.argsort(pairs, kind="stable")
    distinct, begins = np.unique(pairs[order], return_index=True)
    places = places[order]
    for pair, begin, end in zip(distinct.tolist(), begins.tolist(), [*begins[1:].tolist(), len(places)]):
        rank = merged(pair)
        if rank >= 0:
            index[rank, pair] = places[begin:end].tolist()
    known = vocabulary.pairs
    queue = list(index)
    heapq.heapify(queue)
    while queue:
        key = heapq.heappop(queue)
        rank, pair = key
        left, right = pair >> 32, pair & 0xFFFFFFFF
        # Left to right, as overlapping places (a a a) merge from the left.
        for i in sorted(index.pop(key, ())):
            if ids[i] != left or last[i]:
                continue
            j = follows[i]
            if ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            last[i] = last[j]
            after = follows[j]
            follows[i] = after
            if after < n:
                leads[after] = i
            if not last[i]:
                touched = rank << 32 | ids[after]
                r = known.get(touched)
                if r is None:
                    r = merged(touched)
                if r >= 0:
                    k = (r, touched)
                    if k in index:
                        index[k].append(i)
                    else:
                        index[k] = [i]
                        heapq.heappush(queue, k)
            if not first[i]:
                before = leads[i]
                touched = ids[before] << 32 | rank
                r = known.get(touched)
                if r is None:
                    r = merged(touched)
                if r >= 0:
                    k = (r, touched)
                    if k in index:
                        index[k].append(before)
                    else:
                        index[k] = [before]
                        heapq.heappush(queue, k)
    left_ids = np.array(ids, np.int64)
    kept = left_ids >= 0
    packed = left_ids[kept].astype("<u4").tobytes()
    upto = (4 * np.cumsum(kept)[ends - 1]).tolist() if n else []
    for k, a, b in zip(rest, [0, *upto], upto):
        done[k] = packed[a:b]
    return [done[k] for k in range(len(words))]


def _parts(words: list[str], size: int) -> Iterator[list[str]]:
    """The words in parts of so many bytes at most, or of one longer word."""
    held, n = [], 0
    for word in words:
        length = len(word) if word.isascii() else len(word.encode("utf-8", "surrogatepass"))
        if held and n + length > size:
            yield held
            held, n = [], 0
        held.append(word)
        n += length
    if held:
        yield held


def encode_block(texts: list[str], vocabulary: Ranks) -> Iterator[bytes]:
    """The ids of each text, packed as little-endian unsigned 32-bit integers."""
    split, new = [], set()
    for text in texts:
        words = vocabulary.split(text)
        ids = vocabulary.known.look_up(words)
        # Of the words only those that aren't known yet are held, with their places.
        missing = [(i, words[i]) for i, x in enumerate(ids) if x is None] if None in ids else []
        new.update([w for _, w in missing])
        split.append((ids, missing))
    found: dict[str, bytes] = {}
    for part in _parts(list(new), REPLAYED):
        found.update(zip(part, replay([w.encode("utf-8", "surrogatepass") for w in part], vocabulary)))
    for ids, missing in split:
        for i, w in missing:
            ids[i] = found[w]
        yield b"".join(ids)
    vocabulary.known.add(found)


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[list[str]]:
    held, n = [], 0
    for text in chain.from_iterable(column.slice(at, TEXTS).to_pylist() for at in range(0, len(column), TEXTS)):
        if held and n + len(text) > size:
            yield held
            held, n = [], 0
        held.append(text)
        n += len(text)
    if held:
        yield held


def _decoded(packed: bytes, vocabulary: Ranks) -> bytes:
    return b"".join(map(vocabulary.token.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``(id_col, ids)``: the ids of every whole text, packed; null and empty texts have none.

    With ``decoded`` a column of that name has what ``decode`` would add, in the
    same worker, so that the vocabulary is held once for both.

    A text of any length is encoded whole, as a block of its own if it is
    longer than one.  Null ids pass through, repeated rows are repeated, other
    columns are ignored, and an empty table has no rows.
    """

    def run(batches):
        vocabulary = ranks(path, pattern)
        for batch in batches:
            at = 0
            for block in blocks(batch.column(1)):
                packed = list(encode_block(block, vocabulary))
                columns = [packed, [_decoded(x, vocabulary) for x in packed]] if decoded else [packed]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), *(pa.array(c, pa.binary()) for c in columns)], names)
                at += len(block)

    names = [id_col, "ids", "decoded"] if decoded else [id_col, "ids"]
    source = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} binary" for n in names[1:]))


def decode(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``: the bytes that packed ids stand for; null ids give null."""

    def run(batches):
        vocabulary = ranks(path, pattern)
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                part = batch.slice(begin, TEXTS)
                ids = part.column(at).to_pylist()
                out = [None if x is None else _decoded(x, vocabulary) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    at = encoded.columns.index(ids_col)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, kind + ", decoded binary")


