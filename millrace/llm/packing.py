"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

Documents are encoded and, if longer than a sequence, cut into pieces.  Whole
pieces fill a sequence each.  The others are dealt at random over *islands* of
bounded size.  An island's chromosome is a list of bins (groups of pieces): the
first is a best-fit decreasing packing, the rest best-fit packings of noisy
orders.  Crossover injects well-filled bins of one parent whole into another,
drops the bins that hold a piece twice and best-fits the displaced pieces; a
displaced piece may first take the place of one or two smaller ones of a bin
that it fills better, so that what is left to place is small.
After every epoch each island sends its best-filled bins, as multisets of
lengths, around a ring; where the neighbour has pieces of these lengths they
are injected in the same way.  What stays in badly filled bins moves on to the
next, smaller, round of islands.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_or_empty
from millrace.llm.tokenizing import word_encoder
from millrace.sources.storage import materialize

#: Pieces of an island, chromosomes of an island, generations of an epoch, bins that an island sends on.
ISLAND, POPULATION, GENERATIONS, ELITE = 4096, 8, 120, 64
#: Generations without a bin saved after which an epoch ends.
PATIENCE = 30
#: Least and greatest share of the fullest bins that a crossover injects, and the share of bins that it opens again.
INJECTED, OPENED = (0.1, 0.5), 0.04
#: Epochs of each round, and a bin that is this full is never opened again.
EPOCHS, FULL = 2, 0.999

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of each piece of ``n`` tokens; the first one may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    out = [(0, head)] if head else []
    return out + [(at, capacity) for at in range(head, n, capacity)]


def encode_pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: every document's tokens and an end token, cut.

    ``ids`` holds little-endian unsigned 32-bit integers.  Null and empty texts
    are the end token alone; repeated rows are packed each on its own.
    """
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                ids += tail
                rows += [(doc, k, at, n, ids[4 * at : 4 * (at + n)]) for k, (at, n) in enumerate(cut(len(ids) // 4, capacity))]
                if len(rows) >= 2048:
                    yield _record(rows)
                    rows = []
            yield _record(rows)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, PIECES)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids"])


class Bins:
    """Open bins by free space: the fullest bin with room for a piece is found by bisection."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.free = capacity, []
        self.at: dict[int, list[list[int]]] = {}

    def add(self, members: list[int], free: int) -> None:
        if free in self.at:
            self.at[free].append(members)
        else:
            self.at[free] = [members]
            insort(self.free, free)

    def place(self, item: int, size: int) -> None:
        k = bisect_left(self.free, size)
        if k == len(self.free):
            self.add([item], self.capacity - size)
            return
        free = self.free[k]
        members = self.at[free].pop()
        if not self.at[free]:
            del self.at[free]
            del self.free[k]
        members.append(item)
        self.add(members, free - size)

    def all(self) -> list[list[int]]:
        return [members for group in self.at.values() for members in group]


def best_fit(order: list[int], sizes: list[int], capacity: int, kept: list[list[int]] = ()) -> list[list[int]]:
    """Bins of the items, put in this order each into the fullest kept or new bin that has room."""
    bins = Bins(capacity)
    for members in kept:
        bins.add(list(members), capacity - sum(sizes[i] for i in members))
    for item in order:
        bins.place(item, sizes[item])
    return bins.all()


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins filled as unevenly as possible; larger is better."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def exchange(members: list[int], pool: list[tuple[int, int]], sizes: list[int], capacity: int) -> None:
    """Let the piece of the pool that fills a bin best take the place of one or two of its pieces, which go to the pool.

    ``pool`` is sorted by size.
    """
    free = capacity - sum(sizes[i] for i in members)
    if not free:
        return
    gain, out, at = 0, (), 0
    for k, i in enumerate(members):
        for those in ((i,), *((i, j) for j in members[:k])):
            room = sum(sizes[x] for x in those)
            place = bisect_right(pool, (room + free, len(sizes))) - 1
            if place >= 0 and pool[place][0] - room > gain:
                gain, out, at = pool[place][0] - room, those, place
    if gain:
        members.append(pool.pop(at)[1])
        for i in out:
            members.remove(i)
            insort(pool, (sizes[i], i))


def inject(bins: list[list[int]], injected: list[list[int]], sizes: list[int], capacity: int, luck: random.Random) -> list[list[int]]:
    """Put whole bins into a chromosome, drop the bins they overlap and best-fit what that displaces."""
    taken = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in bins:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    # Emptiest bins and one or two others are opened again, so that the displaced meet others than the bins' leavings.
    kept.sort(key=lambda b: sum(sizes[i] for i in b))
    opened = min(len(kept), max(2, int(OPENED * len(kept))))
    displaced += [i for b in kept[:opened] for i in b]
    kept = kept[opened:]
    for _ in range(min(2, len(kept))):
        displaced += kept.pop(luck.randrange(len(kept)))
    pool = sorted((sizes[i], i) for i in displaced)
    luck.shuffle(kept)
    for b in kept:
        exchange(b, pool, sizes, capacity)
    return best_fit([i for _, i in reversed(pool)], sizes, capacity, [*injected, *kept])


def realise(patterns: list[tuple[int, ...]], sizes: list[int]) -> list[list[int]]:
    """Bins of this island's pieces with the lengths of the patterns, as many as there are pieces for."""
    stock: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        stock.setdefault(n, []).append(i)
    out = []
    for pattern in patterns:
        got = []
        for n in pattern:
            if not stock.get(n):
                break
            got.append(stock[n].pop())
        if len(got) == len(pattern):
            out.append(got)
        else:
            for i in got:
                stock[sizes[i]].append(i)
    return out


def evolve(sizes: list[int], capacity: int, seed: int, start: list[list[int]] | None, guests: list[tuple[int, ...]]) -> list[list[int]]:
    """One epoch of an island; never worse than best-fit decreasing or than ``start``, and over at the lower bound."""
    luck = random.Random(seed)
    items = range(len(sizes))
    first = start or best_fit(sorted(items, key=sizes.__getitem__, reverse=True), sizes, capacity)
    least = -(-sum(sizes) // capacity)
    if len(first) == least:
        return first
    people = [first]
    while len(people) < POPULATION:
        people.append(best_fit(sorted(items, key=lambda i: sizes[i] * (1 + luck.uniform(-0.1, 0.1)), reverse=True), sizes, capacity))
    if guests:
        people.append(inject(first, realise(guests, sizes), sizes, capacity, luck))
    ranked = sorted(((fitness(b, sizes, capacity), -k, b) for k, b in enumerate(people)), reverse=True, key=lambda x: x[:2])
    fewest, since = len(ranked[0][2]), 0
    for born in range(GENERATIONS):
        if fewest == least or since == PATIENCE:
            break
        # Each parent is the better of two; they differ.
        giver, taker = (min(luck.sample(range(len(ranked)), 2)) for _ in range(2))
        if giver == taker:
            taker = (taker + 1) % len(ranked)
        donor = sorted(ranked[giver][2], key=lambda b: sum(sizes[i] for i in b) + luck.random(), reverse=True)
        good = donor[: max(1, int(len(donor) * luck.uniform(*INJECTED)))]
        child = inject(ranked[taker][2], good, sizes, capacity, luck)
        ranked.append((fitness(child, sizes, capacity), -len(people) - born, child))
        ranked = sorted(ranked, reverse=True, key=lambda x: x[:2])[:POPULATION]
        since = 0 if len(ranked[0][2]) < fewest else since + 1
        fewest = len(ranked[0][2])
    return ranked[0][2]


def _epoch(pieces: DataFrame, guests: DataFrame | None, capacity: int, seed: int) -> DataFrame:
    """Evolve every island once.

    Gives its pieces with ``bin``, ``offset`` in it and ``filled``, the tokens
    of the bin, and rows without ``uid`` for the patterns it sends on.
    """
    kind = "uid bigint, length bigint, island bigint, bin bigint, offset bigint, filled bigint, pattern array<int>"
    names = ["uid", "length", "island", "bin", "offset", "filled", "pattern"]

    def run(key, mine, sent):
        island = int(key[0])
        mine = mine.sort_values(["length", "uid"], kind="stable", ignore_index=True)
        uids, sizes = mine["uid"].tolist(), mine["length"].tolist()
        start = None
        if sizes and (mine["bin"] >= 0).all():
            start = [g.tolist() for g in mine.groupby("bin").indices.values()]
        patterns = [] if sent is None else [tuple(p) for p in sent["pattern"]]
        bins = evolve(sizes, capacity, seed * 1_000_003 + island, start, patterns) if sizes else []
        rows = []
        for k, members in enumerate(bins):
            at, filled = 0, sum(sizes[i] for i in members)
            for i in members:
                rows.append((uids[i], sizes[i], island, k, at, filled, None))
                at += sizes[i]
        best = sorted((b for b in bins if len(b) > 1 and sum(sizes[i] for i in b) >= FULL * capacity), key=len)
        rows += [(None, None, island, None, None, None, [sizes[i] for i in b]) for b in best[:ELITE]]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({n: "Int64" for n in names[:-1]})

    if guests is None:
        return pieces.groupBy("island").applyInPandas(lambda key, mine: run(key, mine, None), kind)
    return pieces.groupBy("island").cogroup(guests.groupBy("island")).applyInPandas(run, kind)


def pack(pieces: DataFrame, capacity: int = 2048, seed: int = 7) -> DataFrame:
    """``(uid, sequence_id, offset)`` for pieces ``(uid, length)`` with unique ``uid`` and lengths of 1 to ``capacity``.

    As few sequences as the search finds.  A piece that fills a sequence has
    one of its own.  Every round deals what is left to islands of about
    ``ISLAND`` pieces; the rounds end when one island holds all of it, or when
    hardly a bin was filled.  In that last case every island may keep a bin
    that is filled in part, which is one bin above the bound for each
    ``ISLAND`` pieces at most.  An empty frame gives an empty frame.
    """
    done = [pieces.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    rest = pieces.where(F.col("length") < capacity).select("uid", "length")
    left, level = rest.count(), 0
    while left:
        islands = -(-left // ISLAND)
        now = rest.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(seed + level)), F.lit(islands)).alias("island"), F.lit(-1).cast("bigint").alias("bin"))
        guests = None
        for epoch in range(EPOCHS if islands > 1 else 1):
            both = materialize(_epoch(now, guests, capacity, seed + 31 * level + epoch), "islands")
            now = both.where(F.col("uid").isNotNull())
            guests = both.where(F.col("uid").isNull()).select(F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "pattern")
        # Level, island and bin in one long; those of whole pieces are negative.
        number = F.lit(level << 58) + F.shiftleft(F.col("island"), 24) + F.col("bin")
        placed = now.select("uid", "length", "filled", number.alias("sequence_id"), "offset")
        full = F.col("filled") >= FULL * capacity
        rest = placed.where(~full).select("uid", "length")
        following = rest.count() if islands > 1 else 0
        last = islands == 1 or following > 0.9 * left
        done.append((placed if last else placed.where(full)).select("uid", "sequence_id", "offset"))
        if last:
            break
        left, level = following, level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, cut and pack all rows of ``docs``.

    ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` per
    piece: ``sequence_id`` and ``offset`` say where ``encode_pieces``' tokens
    from ``start`` on go.  Rows of one id are packed each on its own; a null id
    stays null; other columns are ignored.
    """
    pieces = encode_pieces(docs, vocabulary, end_id, capacity, id_col, text_col)
    digest = materialize(
        pieces.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")),
        "pieces",
    )
    placed = pack(digest.select("uid", "length"), capacity)
    return digest.join(placed, "uid").drop("uid")
