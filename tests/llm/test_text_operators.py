"""Training-data operators on whole texts against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import binary_records, bpe, line_dedup, packing, quality, sharding, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, length bigint, shard int, id string, line string"
LONG = " ".join(f"w{i}" for i in range(30_000))


def corpus(spark, texts, first=0):
    """Documents with columns whose names the operators use themselves."""
    rows = [(first + i, t, "en" if i % 2 else None, None if i % 3 else "s", None if t is None else len(t), 1, 2, 3, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGE = [None, "", " \t\n", "One", "one two", "one two three", "One two three", "ÀÉ ünï 日本語 text here", LONG, LONG, "a\n\nb\n", "x" * 5000]


# SimHash


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints, bits=2):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    low = {}
    for i, k in enumerate(ids):
        low[find(i)] = min(k, low.get(find(i), k))
    return {k: low[find(i)] for i, k in enumerate(ids)}


def test_fingerprints_and_components(spark):
    luck = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(luck.choices(words, k=400)) for _ in range(5)]
    texts = EDGE + base + [b + f" tail{k}" for b in base for k in range(8)] + base
    got = simhash.simhash_components(corpus(spark, texts)).collect()
    prints = [slow_fingerprint(t) for t in texts]
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{p:016x}" for i, p in enumerate(prints)}
    assert {r["doc_id"]: r["component_id"] for r in got} == slow_components(list(range(len(texts))), prints)


@pytest.mark.parametrize("long_list", [64, 2])
def test_near_pairs_are_all_pairs(spark, monkeypatch, long_list):
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    luck = random.Random(long_list)
    prints = {luck.getrandbits(64) for _ in range(20)}
    for p in list(prints):
        prints |= {p ^ (1 << luck.randrange(64)) ^ (luck.randrange(2) << luck.randrange(64)) for _ in range(8)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {frozenset((r["fp_a"], r["fp_b"])) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()}
    assert got == {frozenset((a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}


def test_the_tally_is_that_of_shared_groups(spark):
    luck = random.Random(9)
    prints = [luck.getrandbits(64) for _ in range(6)]
    # The first bytes of each print with some other bytes, so that pairs agree in any number of positions.
    prints += [sum((luck.choice([p, luck.getrandbits(64)]) >> 8 * i & 255) << 8 * i for i in range(8)) for p in prints for _ in range(12)] + [p ^ 1 << luck.randrange(64) for p in prints]
    signed = [p - (1 << 64) if p >> 63 else p for p in set(prints)]
    agree = lambda a, b: [i for i in range(8) if (a ^ b) >> 8 * i & 255 == 0]
    shared = {(a, b): sum(set(g) <= set(agree(a, b)) for g in simhash.GROUPS) for a in signed for b in signed if a < b}
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    keep = simhash.Scratch()
    assert {(r["fp_a"], r["fp_b"]): r["tally"] for r in simhash.tallied_pairs(frame, keep).collect()} == {k: n for k, n in shared.items() if n}
    keep.clear()
    assert {n for n in shared.values()} >= {0, 1, 3, 7} and all((n >= 3) == (len(agree(*k)) >= 6) for k, n in shared.items())
    # A lower minimum gives more candidates and the same links.
    assert sorted(simhash.near_pairs(frame).collect()) == sorted(simhash.near_pairs(frame, least=1).collect())


def test_one_document_of_a_group_stays(spark):
    docs = corpus(spark, ["a b c d", "A b c d", "e f g h", None, ""]).unionByName(corpus(spark, ["a b c d"])).unionByName(corpus(spark, ["q"]).withColumn("doc_id", F.lit(None).cast("bigint")))
    kept = simhash.simhash_near_dedup(docs)
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in kept.collect()) == [(False, None), (True, 0), (True, 2), (True, 3)]
    assert kept.columns == docs.columns
    assert simhash.simhash_near_dedup(docs.limit(0)).count() == 0


def test_wide_fingerprints_find_copies_of_five_word_similarity(spark):
    luck = random.Random(13)
    texts = []
    for k in range(150):
        words = luck.choices([f"w{i}" for i in range(900)], k=120)
        # Of 116 shingles one word changes 5 and two words 10: similarities of 0.92 and 0.84.
        places = luck.sample([20, 40, 60, 80, 100], 1 + k % 2)
        texts.append((words, ["other" if i in places else w for i, w in enumerate(words)]))
    sets = [set(simhash.shingle_hashes([w.encode() for w in ws], 5).tolist()) for pair in texts for ws in pair]
    assert all(len(a & b) / len(a | b) >= 0.8 for a, b in zip(sets[::2], sets[1::2]))
    prints = [simhash.wide_fingerprint(np.array(sorted(x), np.uint64)) for x in sets]
    rows = [(i, p, np.frombuffer(p, ">i8").tolist()) for i, p in enumerate(prints)]
    keep = simhash.Scratch()
    nodes = spark.createDataFrame([(*r[:1], bytearray(r[1]), r[2]) for r in rows], "lid bigint, print binary, words array<bigint>")
    assert simhash.wide_postings(nodes).groupBy("lid").count().select("count").distinct().collect() == [(192,)]
    lists = {}
    for r in simhash.wide_candidates(nodes, keep).collect():
        lists.setdefault(r["bucket"], set()).add(r["lid"])
    keep.clear()
    met = {(a, b) for got in lists.values() for a in got for b in got if a < b}
    # No list holds a fingerprint that is unlike all others in it.
    assert {(a, b) for a, b in met if a // 2 != b // 2} == set()
    assert len(met) >= 0.97 * len(texts)


def test_near_dedup_finds_copies_without_minhash(spark, monkeypatch):
    import corpus_pipeline

    luck = random.Random(14)
    texts = [" ".join(luck.choices([f"w{i}" for i in range(900)], k=120)) for _ in range(4)]
    monkeypatch.setattr(simhash, "copy_buckets", lambda hashes: [])
    kept = corpus_pipeline.near_dedup(spark, corpus(spark, [*texts, *(t.replace(" ", " more ", 1) for t in texts), "", None]), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 8]


def test_pipeline_drops_near_copies_of_five_word_similarity(spark):
    import corpus_pipeline

    luck = random.Random(12)
    base = [luck.choices([f"w{i}" for i in range(900)], k=120) for _ in range(4)]
    changed = lambda ws, places: " ".join("other" if i in places else w for i, w in enumerate(ws))
    # Of 116 shingles one word changes 5 and four words 20: a similarity of 0.92 and one of 0.71.
    texts = [" ".join(b) for b in base] + [changed(b, {60}) for b in base] + [changed(b, {20, 50, 80, 110}) for b in base] + [base[0][0].upper(), base[0][0]]
    close = [(slow_fingerprint(texts[i]) ^ slow_fingerprint(texts[i + 4])).bit_count() for i in range(4)]
    assert max(close) > 2
    kept = corpus_pipeline.near_dedup(spark, corpus(spark, texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 8, 9, 10, 11, 12]


# Packing


def packed_rows(spark, texts):
    return packing.pack_documents(corpus(spark, texts), public_tokenizers.path("byte_bpe_50k.json")).collect()


def test_packing_is_whole_and_tight(spark):
    luck = random.Random(2)
    texts = EDGE + [" ".join(luck.choices(["alpha", "beta", "gam", "delta"], k=luck.randint(1, 3000))) for _ in range(150)]
    rows = packed_rows(spark, texts)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        mine = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and sum(r["length"] for r in mine) == len(ids)
        assert len(mine) == 1 if len(ids) <= 2048 else all(r["length"] == 2048 for r in mine[1:])
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for mine in by_sequence.values():
        at = 0
        for r in sorted(mine, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_packing_over_many_islands(spark, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND", 64)
    luck = random.Random(5)
    pieces = spark.createDataFrame([(i, luck.choice([2048, luck.randint(1, 2047), luck.randint(1, 300)])) for i in range(1500)], "uid bigint, length bigint")
    got = packing.pack(pieces).join(pieces, "uid").collect()
    assert len(got) == 1500
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in bins.values():
        members.sort()
        assert members[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(members, members[1:])) and sum(n for _, n in members) <= 2048
    assert len(bins) <= 1.02 * sum(r["length"] for r in got) / 2048 + 1


def test_crossover_keeps_every_piece_once():
    luck = random.Random(3)
    sizes = [luck.randint(1, 90) for _ in range(200)]
    a = packing.best_fit(list(range(200)), sizes, 100)
    b = packing.best_fit(list(range(199, -1, -1)), sizes, 100)
    child = packing.inject(a, b[:10], sizes, 100, luck)
    assert sorted(i for x in child for i in x) == list(range(200)) and all(sum(sizes[i] for i in x) <= 100 for x in child)
    assert {tuple(x) for x in b[:10]} & {tuple(x[: len(y)]) for x in child for y in b[:10]}
    guests = packing.realise([(sizes[0], sizes[1]), (1000,)], sizes)
    assert [[sizes[i] for i in g] for g in guests] == [[sizes[0], sizes[1]]]


def uniform(luck, n=1200):
    return [luck.randint(300, 1300) for _ in range(n)]


def few_classes(luck, n=1200):
    return [luck.choice([683, 690, 700, 1024, 1030, 1010, 512, 341, 670, 655]) for _ in range(n)]


def triples(luck, n=400):
    out = []
    for _ in range(n):
        a = luck.randint(400, 1000)
        b = luck.randint(400, min(1000, 1748 - a))
        out += [a, b, 2048 - a - b]
    return out


def decreasing(sizes):
    return packing.best_fit(sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True), sizes, 2048)


@pytest.mark.parametrize(("lengths", "saved"), [(uniform, 3), (few_classes, 5), (triples, 5)])
def test_crossover_saves_bins_over_best_fit_decreasing(monkeypatch, lengths, saved):
    sizes = lengths(random.Random(1))
    found = packing.evolve(sizes, 2048, 1, None, [])
    assert sorted(i for b in found for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 2048 for b in found)
    assert len(decreasing(sizes)) - len(found) >= saved
    # Without a generation there is the seed and its noisy kin only.
    monkeypatch.setattr(packing, "GENERATIONS", 0)
    assert len(packing.evolve(sizes, 2048, 1, None, [])) > len(found)


def test_migration_saves_bins(monkeypatch):
    sizes = triples(random.Random(2))
    guests = [tuple(sizes[3 * k : 3 * k + 3]) for k in range(0, 400, 4)]
    monkeypatch.setattr(packing, "GENERATIONS", 40)
    alone, met = (packing.evolve(sizes, 2048, 3, None, x) for x in ([], guests))
    assert len(met) < len(alone) < len(decreasing(sizes))


def test_islands_beat_best_fit_decreasing(spark, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND", 400)
    sizes = few_classes(random.Random(4))
    got = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "uid bigint, length bigint"))
    assert got.select("sequence_id").distinct().count() < len(decreasing(sizes))


def test_pieces_without_an_id(spark):
    docs = corpus(spark, ["a b", "c d e"]).withColumn("doc_id", F.lit(None).cast("bigint"))
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(rows) == 2 and {r["doc_id"] for r in rows} == {None} and len({r["offset"] for r in rows}) == 2


def test_nothing_to_pack(spark):
    assert packed_rows(spark, []) == []


# Sharding


def test_shards_are_even_whole_and_gapless(spark):
    docs = corpus(spark, EDGE + [f"text {i}" for i in range(500)]).unionByName(corpus(spark, ["text 0"] * 3, first=12)).unionByName(corpus(spark, EDGE[:4]).withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = sharding.shard_rows(docs, 7).collect()
    counts = {}
    for r in rows:
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == docs.count() and set(counts) == set(range(7))
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[7]["size"] == len(EDGE[7].encode()) + 16 and by_id[7]["text_crc32"] == zlib.crc32(EDGE[7].encode()) and by_id[0]["size"] == 16
    assert sharding.shard_rows(docs.limit(0), 7).count() == 0


def test_flow_equals_a_walk_of_single_keys():
    luck = random.Random(6)
    owners = [luck.randrange(5) for _ in range(30)]
    owners[:5] = range(5)
    counts = [luck.randrange(40) for _ in owners]
    limits = sharding.bounds(sum(counts), 5)
    room, placed = list(limits), {}
    overflow = []
    for arc, n in enumerate(counts):
        for k in range(n):
            if room[owners[arc]]:
                room[owners[arc]] -= 1
                placed[arc, k] = owners[arc]
            else:
                overflow.append((arc, k))
    for step in range(1, len(owners)):
        still = []
        for arc, k in overflow:
            shard = owners[(arc + step) % len(owners)]
            if room[shard]:
                room[shard] -= 1
                placed[arc, k] = shard
            else:
                still.append((arc, k))
        overflow = still
    got = {(arc, k): shard for arc, first, end, shard, _ in sharding.flow(counts, owners, limits) for k in range(first, end)}
    assert got == placed and not overflow


def test_one_more_shard_moves_few_rows(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    before = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, 20).collect()}
    after = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, 21).collect()}
    # A new shard has to take one row in 21; clockwise overflow moves as many again at most.
    assert len(before) / 21 <= sum(before[k] != after[k] for k in before) + len(before) // 420 and sum(before[k] != after[k] for k in before) <= 2 * len(before) / 21


# Binary records


def test_records_round_trip(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = EDGE + ["İstanbul don't 12 ²", "<|endoftext|> stays text"]
    folder = "file://" + str(tmp_path / "records")
    manifest = binary_records.write_records(corpus(spark, texts), path, folder, shards=3)
    rows = sorted(binary_records.read_records(spark, manifest).collect(), key=lambda r: r["start"])
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    start = 0
    for i, (r, t) in enumerate(zip(rows, texts, strict=True)):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert (r["doc_id"], r["start"], bytes(r["ids"])) == (i, start, ids)
        start += len(ids) // 4
    nameless = corpus(spark, ["q r"]).withColumn("doc_id", F.lit(None).cast("bigint")).unionByName(corpus(spark, ["s"]))
    named = binary_records.read_records(spark, binary_records.write_records(nameless, path, folder + "-2", shards=2)).orderBy("start").collect()
    assert [(r["doc_id"], r["start"]) for r in named] == [(None, 0), (0, 3)]
    shard = manifest[-1]
    order = list(range(shard["records"]))[::-1]
    picked = list(binary_records.read_at(shard["data"], shard["entries"], order))
    assert [d for d, _ in picked] == sorted((r["doc_id"] for r in rows if r["shard"] == shard["shard"]), reverse=True)
    file = shard["data"].removeprefix("file://")
    data = bytearray(open(file, "rb").read())
    data[20] ^= 1
    open(file, "wb").write(data)
    with pytest.raises(Exception, match="bad payload"):
        binary_records.read_records(spark, manifest).collect()
    assert binary_records.write_records(corpus(spark, []), path, folder) == []


def test_wide_ids_and_bad_frames():
    ids = np.array([1, 70_000], "<u4").tobytes()
    for doc_id in (-5, None):
        for packed in (ids, ids[:4]):
            assert binary_records.parse(binary_records.payload_of(doc_id, packed)) == (doc_id, packed)
    framed = binary_records.frame(b"abc")
    assert binary_records.unframe(framed) == (b"abc", len(framed))
    for bad in (framed[:-1], framed[:5], b"\1" + framed[1:]):
        with pytest.raises(Exception):
            binary_records.unframe(bad)


# Byte-level BPE


def test_encoding_equals_the_library_and_decodes_back(spark):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    luck = random.Random(8)
    texts = EDGE + ["aaaaaaaaaaaaa", "abab" * 200] + ["".join(luck.choices("abcdé ñ\n1$.'日\x85", k=luck.randint(0, 80))) for _ in range(300)]
    both = bpe.decode(bpe.encode(corpus(spark, texts), path), path).collect()
    assert len(both) == len(texts)
    for r in both:
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()


def test_decoding_in_the_worker_that_encodes_is_decoding(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = corpus(spark, EDGE)
    assert sorted(bpe.encode(docs, path, decoded=True).collect(), key=str) == sorted(bpe.decode(bpe.encode(docs, path), path).collect(), key=str)
    assert bpe.encode(docs.limit(0), path, decoded=True).count() == 0


def test_what_a_block_of_new_words_takes_is_bounded(monkeypatch):
    import tracemalloc

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    luck = random.Random(15)
    words = sorted({"".join(luck.choices("abcdefghijklmnopqrstuvwxyzé", k=luck.randint(6, 14))) for _ in range(60_000)})
    peaks, got = [], []
    for replayed, pairs in ((1 << 30, 1 << 30), (bpe.REPLAYED, 20_000)):
        monkeypatch.setattr(bpe, "REPLAYED", replayed)
        monkeypatch.setattr(bpe, "PAIRS", pairs)
        vocabulary = bpe.Ranks(path, public_tokenizers.PATTERN)
        tracemalloc.start()
        got.append(list(bpe.encode_block([" ".join(words), "x" * 3000 + " y"], vocabulary)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(vocabulary.pairs) <= pairs
    assert got[0] == got[1] and 2 * peaks[1] < peaks[0]


def test_encoding_without_rows_or_ids(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = corpus(spark, ["some words", None]).withColumn("doc_id", F.lit(None).cast("bigint"))
    rows = bpe.decode(bpe.encode(docs, path), path).collect()
    assert sorted(bytes(r["decoded"]) for r in rows) == [b"", b"some words"] and {r["doc_id"] for r in rows} == {None}
    assert bpe.decode(bpe.encode(docs.limit(0), path), path).count() == 0


# Line dedup


def slow_line_classes(lines):
    """Components of all lines but blank ones by exact similarity of all pairs."""
    norm = {}
    for at, line in lines:
        n = line.strip(" \t\r").lower()
        if n:
            norm.setdefault(n, at)
    names = list(norm)
    sets = [{n[i : i + 6] for i in range(len(n) - 5)} for n in names]
    parent = list(range(len(names)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(names)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    head = {}
    for i, n in enumerate(names):
        head[find(i)] = min(norm[n], head.get(find(i), norm[n]))
    return {n: head[find(i)] for i, n in enumerate(names)}


def test_lines_are_classed_as_by_all_pairs(spark):
    luck = random.Random(11)
    words = ["".join(luck.choices("abcdefghij", k=luck.randint(2, 7))) for _ in range(300)]
    base = [" ".join(luck.choices(words, k=luck.choice([8, 20, 60, 150, 400]))) for _ in range(25)]
    near = [b.replace(b.split(" ")[3], "changed", 1) for b in base]
    family = [f"{base[0]} page {k}" for k in range(40)]
    texts = [None, "", "short\nshort", *("\n".join(luck.sample(base + near + family, 4) + ["short"]) for _ in range(60)), base[1].upper() + "\r"]
    rows = line_dedup.line_classes(corpus(spark, texts)).collect()
    lines = [((d, k), line) for d, t in enumerate(texts) for k, line in enumerate((t or "").split("\n"))]
    want = slow_line_classes(lines)
    got = {(r["doc_id"], r["line_no"]): ((r["first_doc"], r["first_line"]), r["kept"]) for r in rows}
    assert len(rows) == len(lines) == len(got)
    # Banding may miss a link at the very threshold; none of these is there.
    for at, line in lines:
        head = want.get(line.strip(" \t\r").lower(), at)
        assert got[at] == (head, head == at)


def all_similar_pairs(lines):
    """Pairs of lines whose shingle sets have a similarity of 0.8 or more, exactly: such sets share one of each one's rarest shingles."""
    sets = [{line[i : i + 6] for i in range(len(line) - 5)} for line in lines]
    count = {}
    for s in sets:
        for x in s:
            count[x] = count.get(x, 0) + 1
    index, pairs = {}, []
    for i in sorted(range(len(lines)), key=lambda i: len(sets[i])):
        n = len(sets[i])
        rare = sorted(sets[i], key=lambda x: (count[x], x))[: n - -(-8 * n // 10) + 1] if n else []
        near = set()
        for x in rare:
            near.update(j for j in index.get(x, ()) if 10 * len(sets[j]) >= 8 * n)
            index.setdefault(x, []).append(i)
        for j in near:
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * (n + len(sets[j]) - both):
                pairs.append((i, j))
    return pairs


def test_links_of_a_real_table_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = {}
    for r in docs.orderBy("doc_id").collect():
        for k, line in enumerate((r["text"] or "").split("\n")):
            norm = line.strip(" \t\r").lower()
            if norm:
                first.setdefault(norm, (r["doc_id"], k))
    lines = list(first)
    pairs = all_similar_pairs(lines)
    classes = {(r["doc_id"], r["line_no"]): (r["first_doc"], r["first_line"]) for r in line_dedup.line_classes(docs).collect()}
    found = sum(classes[first[lines[i]]] == classes[first[lines[j]]] for i, j in pairs)
    assert len(pairs) > 200 and found >= 0.95 * len(pairs)


def test_lines_of_few_distinct_shingles_meet(spark):
    pairs = [("ha ho " * 40, "ha ho " * 260), ("-" * 30, "-" * 45), ("short line", "Short line "), ("abcdefg", "abcdefg"), ("=-" * 9, "=-" * 500)]
    rows = line_dedup.line_classes(corpus(spark, [a for a, _ in pairs] + [b for _, b in pairs])).collect()
    assert {r["doc_id"]: r["first_doc"] for r in rows} == {i: i % 5 for i in range(10)}


def test_different_lines_of_one_name_are_linked_to_equal_ones(spark, monkeypatch):
    original = line_dedup._named
    monkeypatch.setattr(line_dedup, "_named", lambda lines, *more: original(lines, *more).withColumn("lid", F.when(F.col("lid") % 2 == 0, F.lit(4)).otherwise(F.col("lid"))))
    texts = [f"line number {i % 30} of {'abcdefghij'[i % 10] * 9}" for i in range(60)]
    rows = line_dedup.line_classes(corpus(spark, texts)).collect()
    assert {r["doc_id"]: r["first_doc"] for r in rows} == {i: i % 30 for i in range(60)}


def test_rows_of_one_id_lose_their_own_lines(spark):
    a, b, c = "the first long line of all documents", "another line that is long enough too", "a third one that nothing else has"
    docs = corpus(spark, [f"{a}\n{a}"]).unionByName(corpus(spark, [f"{b}\n{c}"])).withColumn("__id", F.lit(1)).withColumn("__gone", F.lit(1)).withColumn("left", F.lit(2)).withColumn("lines", F.lit("x")).withColumn("row", F.lit(3))
    out = line_dedup.drop_lines(docs)
    assert out.columns == docs.columns and sorted(r["text"] for r in out.collect()) == sorted([a, f"{b}\n{c}"])
    assert line_dedup.line_classes(docs.limit(0)).count() == 0 and line_dedup.drop_lines(docs.limit(0)).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("millrace_lines")]


def test_documents_lose_lines_and_empty_ones_go(spark):
    a, b = "the first long line of all documents", "another line that is long enough too"
    docs = corpus(spark, [f"{a}\nok\n{b}", f"{a.upper()}", f"new words stand here in this place\n{b}", None, ""])
    out = {r["doc_id"]: r for r in line_dedup.drop_lines(docs).collect()}
    assert {k: r["text"] for k, r in out.items()} == {0: f"{a}\nok\n{b}", 2: "new words stand here in this place", 3: None, 4: ""}
    assert out[2]["n_chars"] == len(out[2]["text"])
    assert line_dedup.drop_lines(docs.limit(0)).columns == docs.columns


@pytest.mark.parametrize("slice_of", [512, 2])
def test_lines_of_a_bucket_are_linked_past_its_first_line(spark, monkeypatch, slice_of):
    monkeypatch.setattr(line_dedup, "SLICE", slice_of)
    luck = random.Random(7)
    word = lambda: "".join(luck.choices("abcdefghij", k=9))
    twins = []
    for _ in range(8):
        one = " ".join(word() for _ in range(12))
        twins += [one, one + " x1", one + " y2"]
    docs = corpus(spark, ["\n".join([" ".join(word() for _ in range(12)) for _ in range(6)] + twins)])
    # All lines agree in one band, and no line of a pair need be the first.
    monkeypatch.setattr(line_dedup, "bands", lambda lines: lines.select("lid", F.lit(1).cast("bigint").alias("bucket")))
    rows = sorted(line_dedup.line_classes(docs).collect(), key=lambda r: r["line_no"])
    assert [r["first_line"] for r in rows] == [*range(6), *(6 + i - i % 3 for i in range(24))]


def test_short_lines_take_part(spark):
    a, b = "the first long line of all documents", "another line that is long enough too"
    docs = corpus(spark, [f"{a}\nles.\n\nchapter one 12", f"{a}\nles.\n\nCHAPTER ONE 12", f"{b}\nLes. \n", "chapter one 123\nles", "\n\n"])
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(docs).collect()}
    assert out == {0: f"{a}\nles.\n\nchapter one 12", 2: f"{b}\n", 3: "les", 4: "\n\n"}


# Quality rules


def slow_statistics(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


@pytest.mark.parametrize("text", [None, "", "a b c", "a b c a b c d", "x y x y x y x y", "l1 #\nl1 #\n\n \nl2 |é", "  a b \x85"])
def test_statistics(text):
    assert quality.statistics(text)[:5] == slow_statistics(text)


def test_outliers_of_each_group_go_and_the_rest_stays(spark):
    luck = random.Random(1)
    words = ["".join(luck.choices("etaoin", k=luck.randint(2, 8))) for _ in range(500)]
    clean = [" ".join(luck.choices(words, k=luck.randint(60, 200))) for _ in range(260)]
    junk = [" ".join(w + luck.choice(["$$$", "%%%"]) for w in luck.choices(words, k=100)) for _ in range(30)]
    repeated = [" ".join(words[:5]) + " " + (" ".join(words[5:9]) + " ") * 30]
    texts = clean + junk + repeated + [None, "", "too few words"]
    rows = {r["doc_id"]: r for r in quality.judge(corpus(spark, texts)).collect()}
    assert [rows[i]["kept"] for i in range(len(texts))] == [True] * 260 + [False] * 34
    assert [rows[i]["base_failed"] for i in range(260, len(texts))] == [False] * 30 + [True] * 4
    kept = quality.keep_clean(corpus(spark, texts))
    assert kept.count() == 260 and kept.columns == corpus(spark, []).columns
    assert quality.judge(corpus(spark, [])).count() == 0


def slow_mcd(x, starts=200):
    """The best of many random starts, each followed until it stands still: fast MCD as published, with the operator's floor."""
    luck = np.random.default_rng(0)
    p, h = x.shape[1], int(quality.SUPPORT * len(x)) + 1
    factor = quality.SUPPORT / quality.chi2_cdf(quality.chi2_quantile(quality.SUPPORT, p), p + 2)
    best = np.inf
    for _ in range(starts):
        rows = luck.choice(len(x), p + 1, replace=False)
        for _ in range(15):
            mean, cov = x[rows].mean(0), np.cov(x[rows].T, bias=True) * factor + quality._floor()
            gap = x - mean
            rows = np.argsort(np.einsum("ni,ij,nj->n", gap, np.linalg.inv(cov), gap))[:h]
        cov = np.cov(x[rows].T, bias=True) * factor + quality._floor()
        best = min(best, np.linalg.slogdet(cov)[1])
    return best


def vectors_of(spark, groups):
    rows = [(g, *map(float, v)) for g, x in groups.items() for v in x]
    return spark.createDataFrame(rows, "key string, " + ", ".join(f"{n} double" for n in quality.NAMES))


def test_the_start_of_least_determinant_counts(spark, monkeypatch):
    luck = np.random.default_rng(4)
    # A flat cloud far out on a slanted line, and a quarter of the rows round the middle of all, off that line.
    t = np.r_[luck.normal(-12, 1, 230), luck.normal(12, 1, 230)]
    flat = t[:, None] * np.array([1, 1, 1, -1, 1, -1]) + luck.normal(0, 0.05, (460, 6))
    groups = {"a": np.r_[flat, luck.normal(0, 1.2, (140, 6))], "b": luck.normal(1, 0.5, (300, 6))}
    fits = {r["key"]: r["logdet"] for r in quality.mcd_estimates(vectors_of(spark, groups), ["key"]).collect()}
    assert all(abs(fits[g] - slow_mcd(x)) < 0.15 for g, x in groups.items())
    monkeypatch.setattr(quality, "STARTS", 2)
    chosen = quality.mcd_estimates(vectors_of(spark, groups), ["key"]).where("key = 'a'").first()["logdet"]
    assert fits["a"] <= chosen + 0.15


def test_a_small_group_leans_on_the_group_around_it(spark):
    luck = random.Random(3)
    words = ["".join(luck.choices("etaoin", k=luck.randint(2, 8))) for _ in range(500)]
    rows = [(i, " ".join(luck.choices(words, k=100)), "en", f"s{min(i // 60, 4)}") for i in range(245)]
    rows += [(300 + i, " ".join(w + "$$$" for w in luck.choices(words, k=100)), "en", "s4") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: (r["kept"], r["group_rows"]) for r in quality.judge(docs).collect()}
    assert [got[300 + i][0] for i in range(3)] == [False] * 3 and sum(got[i][0] for i in range(245)) >= 240 and got[244][1] == 8


def test_mcd_finds_the_bulk_among_a_third_of_outliers(spark):
    luck = np.random.default_rng(0)
    bulk, far = luck.normal(1, 0.5, (600, 6)), luck.normal(6, 0.5, (250, 6))
    rows = spark.createDataFrame([("g", *map(float, x)) for x in np.vstack([bulk, far])], "key string, " + ", ".join(f"{n} double" for n in quality.NAMES))
    fit = quality.mcd_estimates(rows, ["key"]).first()
    centre = np.array([fit[f"m{i}"] for i in range(6)])
    assert np.abs(centre - 1).max() < 0.8


