"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

Lines are lower-cased and trimmed; equal ones are one node.  Every character
shingle of a node is hashed; the hash says which of 50 bins the shingle falls in
and the least hash of each bin is kept (one-permutation MinHash).  Five bins make
a band, and lines that agree in a whole band meet in a bucket.  Pairs from the
buckets are verified by the exact Jaccard similarity of their shingle sets, and
a distributed union-find keeps one line of each component.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import text_or_empty
from millrace.llm.graph import connected_components
from millrace.sources.storage import Scratch, discard, materialize, release, remove, scratch_path

#: Characters of a shingle, least similarity, bands of a signature and bins of a band.
SHINGLE, SIMILARITY = 6, 0.8
BANDS, ROWS = 10, 5
#: Longs of a sketch; members of a bucket that meet one copy of what they are held against.
WORDS, SLICE = 16, 256
#: Members of a bucket's largest class that the other lines meet in each round before the one in which they meet all,
#: and the lines that a bucket has to have more of for such a round to be worth it.
ANCHORS, CROWD = (8,), 64
_BLANK = " \t\r"


def _wide(line: Column) -> Column:
    """Four bytes a character, so that a shingle is a slice at a known place."""
    return F.encode(line, "UTF-32")


def _trimmed(line: Column) -> Column:
    # Trimming by a set of characters looks at every character of a line, so only lines that need it are trimmed.
    ragged = F.lit(False)
    for c in _BLANK:
        ragged = ragged | F.startswith(line, F.lit(c)) | F.endswith(line, F.lit(c))
    return F.when(ragged, F.trim(line, F.lit(_BLANK))).otherwise(line)


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(at, norm)`` for every line of every row; ``norm`` is null for blank lines.

    ``at`` is ``(doc_id, line_no, copy)`` with a hash of the whole text, so that
    rows which share an id but not the text are told apart.
    """
    text = text_or_empty(text_col)
    exploded = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("copy"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    norm = F.lower(_trimmed(F.col("line")))
    return exploded.select(F.struct("doc_id", "line_no", "copy").alias("at"), F.when(F.length(norm) > 0, norm).alias("norm"))


def _named(lines: DataFrame, *more: str) -> DataFrame:
    """The lines with two 64-bit names; blank lines are named by their place, so that none has another's."""
    blank = F.col("norm").isNull()
    name = lambda seed: F.when(blank, F.xxhash64(F.lit(seed), "at")).otherwise(F.xxhash64(F.lit(seed + 1), "norm"))
    return lines.select("at", *more, name(0).alias("lid"), name(2).alias("proof"))


class LineTable:
    """Distinct lines, bucketed by ``lid``: ``(lid, proof, last, line, first, n)``.

    Equal lines meet in partial aggregates.  ``proof`` and ``last`` are the
    least and greatest second name of a ``lid``; where they differ, different
    lines share the first one.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        self.spark = docs.sparkSession
        rows = _named(lines_of(docs, id_col, text_col).where(F.col("norm").isNotNull()), "norm")
        grouped = rows.groupBy("lid").agg(F.min("proof").alias("proof"), F.max("proof").alias("last"), F.min("norm").alias("line"), F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        self.path = scratch_path(self.spark, "lines")
        self.name = "millrace_lines_" + self.path.rsplit("-", 1)[1]
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        grouped.write.format("parquet").option("path", self.path).option("compression", "zstd").bucketBy(width, "lid").saveAsTable(self.name)
        release(self.spark)
        self.lines = self.spark.table(self.name).where("proof = last")
        self.clashes = self.spark.table(self.name).where("proof <> last").select("lid")

    def drop(self) -> None:
        self.spark.sql(f"drop table {self.name}")
        remove(self.spark, self.path)


def shingles_of(lines: DataFrame) -> DataFrame:
    """``(lid, s)``: the hash of every shingle of every line, repeats included."""
    # Encoded below the explosion, once a line; in one step with it Spark would encode the line for each place.
    whole = lines.where(F.length("line") >= SHINGLE).select("lid", _wide(F.col("line")).alias("wide"), (F.length("line") - SHINGLE).alias("last"))
    placed = whole.select("lid", "wide", F.explode(F.sequence(F.lit(0), "last")).alias("i"))
    return placed.select("lid", F.xxhash64(F.substring("wide", F.col("i") * 4 + 1, F.lit(4 * SHINGLE))).alias("s"))


def _part(s: str, shift: int, parts: int) -> Column:
    """Which of so many equal parts 24 bits of a hash fall in."""
    return F.shiftright(F.shiftrightunsigned(s, shift).bitwiseAND(F.lit((1 << 24) - 1)) * parts, 24).cast("int")


def bands(lines: DataFrame) -> DataFrame:
    """``(lid, bucket)``: a row for each band that a shingle of the line falls in.

    The lines come bucketed by ``lid``, so that the grouping needs no
    exchange.  An empty bin is a value like any other, so lines of few
    distinct shingles, of which two similar ones differ in few bands or in
    none, meet too.
    """
    binned = shingles_of(lines).select("lid", "s", _part("s", 40, BANDS).alias("band"), _part("s", 16, ROWS).alias("row"))
    least = binned.groupBy("lid", "band").agg(*(F.min(F.when(F.col("row") == k, F.col("s"))).alias(f"m{k}") for k in range(ROWS)))
    return least.select("lid", F.xxhash64("band", *(F.coalesce(f"m{k}", F.lit(0)) for k in range(ROWS))).alias("bucket"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body and the optimiser repeat its name."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_set(line: Column) -> Column:
    """Hashes of a line's distinct shingles."""
    places = F.sequence(F.lit(1), (F.length(line) - SHINGLE) * 4 + 1, F.lit(4))
    return _let(F.struct(_wide(line).alias("wide"), places.alias("places")), lambda x: F.array_distinct(F.transform(x["places"], lambda i: F.xxhash64(F.substring(x["wide"], i, F.lit(4 * SHINGLE))))))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two shingle sets."""
    sets = F.struct(a.alias("a"), b.alias("b"))
    both = lambda s: F.size(F.array_intersect(s["a"], s["b"]))
    return _let(sets, lambda s: _let(both(s), lambda k: k / (F.size(s["a"]) + F.size(s["b"]) - k)))


def sketches(shingles: DataFrame, parity: bool = False) -> DataFrame:
    """``(lid, size, sketch)``: the number of each line's shingles and, in 1024 bits, which bits they fall on.

    With ``parity`` distinct shingles count, and the bits that an odd number of
    them falls on: sharper, as bits that both sets fill tell them apart too, but
    the shingles have to be made distinct first.  Either way the sketches of
    two sets differ in no more bits than the sets differ in shingles, so they
    bound the similarity from above.
    """
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(s, 32) & 63 as int))")
    word = F.shiftrightunsigned("s", 38).bitwiseAND(F.lit(WORDS - 1))
    merge = F.bit_xor if parity else F.bit_or
    words = [merge(F.when(word == k, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"w{k}") for k in range(WORDS)]
    rows = shingles.groupBy("lid", "s").agg(F.lit(1)) if parity else shingles
    drawn = rows.groupBy("lid").agg(F.count(F.lit(1)).alias("size"), *words)
    return drawn.select("lid", F.struct("size", *(f"w{k}" for k in range(WORDS))).alias("sketch"))


def _may_be_similar(a: Column, b: Column, similarity: float) -> Column:
    """False only if two sketches prove that the sets aren't similar: those that are differ in a bounded share of their shingles."""
    differ = sum((F.bit_count(a[f"w{k}"].bitwiseXOR(b[f"w{k}"])) for k in range(WORDS)), F.lit(0))
    return differ <= (a["size"] + b["size"]) * ((1 - similarity) / (1 + similarity)) + 1e-6


def verified(pairs: DataFrame, lines: DataFrame, similarity: float, set_of: Callable[[Column], Column], keep: Scratch) -> DataFrame:
    """Of the pairs ``(a, b, slice)`` those whose lines' shingle sets are similar enough.

    One ``a`` may be in any number of pairs; each slice of them, ``SLICE`` or
    about so many, meets a copy of its line, whose set is built once for them.
    """
    wanted = keep(pairs.groupBy("a", "b").agg(F.min("slice").alias("slice")), "pairs")
    members = wanted.join(lines.select(F.col("lid").alias("b"), "line"), "b").groupBy("a", "slice").agg(F.collect_list(F.struct("b", "line")).alias("members"))
    met = members.join(lines.select(F.col("lid").alias("a"), "line"), "a")
    similar = _let(
        F.struct(set_of(F.col("line")).alias("set"), "members"), lambda x: F.transform(F.filter(x["members"], lambda m: jaccard(x["set"], set_of(m["line"])) >= similarity), lambda m: m["b"])
    )
    return met.select("a", F.explode(similar).alias("b"))


def unsettled(known: DataFrame, similarity: float, anchors: int | None, keep: Scratch) -> DataFrame:
    """Pairs ``(a, b, slice)`` of a bucket and different classes that may be similar; ``known`` has ``(bucket, lid, sketch, root)``.

    Whatever is outside a bucket's largest class meets some members of that
    class, the ``anchors`` with the least hashes, or if no number is given all
    other classes.  Only pairs go of which the sketches prove that they aren't
    similar.  Buckets with many lines outside are dealt over slices, and what
    these lines meet is repeated for each slice.
    """
    sizes = known.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1")
    main = main.select("bucket", F.col("top.root").alias("main"), F.col("n").alias("size"), F.ceil((F.col("n") - F.col("top.n")) / SLICE).cast("int").alias("slices"))
    if anchors is not None:
        # Lines of smaller buckets wait for the last round.
        main = main.where(F.col("size") > CROWD)
    apart = keep(known.join(keep(main.drop("size"), "main"), "bucket"), "apart")
    odd = apart.where("root <> main").select("bucket", "lid", "root", "sketch", F.pmod(F.xxhash64("lid"), F.col("slices")).cast("int").alias("slice"))
    held = apart
    if anchors is not None:
        first = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(anchors), "lid"), "lid")
        held = apart.where("root = main").withColumn("r", F.row_number().over(first)).where(F.col("r") <= anchors)
    rest = held.select("bucket", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("lid").alias("lid_b"), F.col("root").alias("root_b"), (F.col("root") == F.col("main")).alias("in_main"), F.col("sketch").alias("sketch_b"))
    rest = keep(rest, "rest")
    # Two lines outside the largest class meet from both sides; one is enough.
    on = [odd[c] == rest[c] for c in ("bucket", "slice")] + [F.col("root") != F.col("root_b"), F.col("in_main") | (F.col("lid") < F.col("lid_b"))]
    met = odd.join(rest, [*on, _may_be_similar(F.col("sketch"), F.col("sketch_b"), similarity)])
    return met.select(F.least("lid", "lid_b").alias("a"), F.greatest("lid", "lid_b").alias("b"), odd["slice"])


def _merged(classes: DataFrame, tops: DataFrame) -> DataFrame:
    """``classes`` with each root replaced by the root that it has got in ``tops``."""
    above = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return classes.join(above, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")


def links(
    lines: DataFrame,
    similarity: float = SIMILARITY,
    buckets: DataFrame | None = None,
    set_of: Callable[[Column], Column] = shingle_set,
    shingles: Callable[[DataFrame], DataFrame] = shingles_of,
) -> DataFrame:
    """``(node, root)`` of every line that is linked to another.

    Lines of a bucket needn't all meet: those that its first line is linked to
    are one class, and only lines that this leaves in different classes are
    compared further: with a few members of the bucket's largest class, which
    takes in most of a family of near copies, then with more, and what stays
    apart with all, so no link between two classes of a bucket is lost.  Other
    things than lines come with ``(lid, bucket)`` of
    their own, what makes a set of shingle hashes of their ``line`` and what
    makes rows of them.  The result is materialized.
    """
    keep = Scratch()
    # One exchange by bucket serves the count and the join; buckets of one line end there.
    dealt = (bands(lines) if buckets is None else buckets).select("bucket", "lid").repartition("bucket")
    shared = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("lid").alias("lead")).where("n > 1")
    members = keep(dealt.join(shared.hint("shuffle_hash"), "bucket").select("bucket", "lid", "n", "lead"), "buckets")
    release(lines.sparkSession)
    drawn = keep(sketches(shingles(lines.join(members.select("lid").distinct(), "lid", "left_semi"))), "sketches")
    slice_of = F.pmod(F.xxhash64("lid"), F.ceil(F.col("n") / SLICE)).cast("int")
    tried = members.where("lid <> lead").groupBy(F.col("lead").alias("a"), F.col("lid").alias("b")).agg(F.min(slice_of).alias("slice"))
    heads = drawn.select(F.col("lid").alias("a"), F.col("sketch").alias("sketch_a"))
    # A lead's sketch is repeated for each slice of its pairs, as its set is later.
    heads = keep(heads.join(tried.select("a", "slice").distinct(), "a"), "leads")
    tried = keep(tried, "tried")
    stars = tried.join(drawn.withColumnRenamed("lid", "b"), "b").join(heads, ["a", "slice"]).where(_may_be_similar(F.col("sketch_a"), F.col("sketch"), similarity))
    found = keep(verified(stars.select("a", "b", "slice"), lines, similarity, set_of, keep), "links")
    classes = keep.own(connected_components(found, "a", "b"))
    # All pairs with a bucket's first line are settled, so it is out.
    known = keep(members.where("lid <> lead and n > 2").select("bucket", "lid"), "others")
    # Dealt by line, so that making a line's shingles distinct needs no exchange of them.
    sharp = sketches(shingles(lines.join(known.select("lid").distinct(), "lid", "left_semi").repartition("lid")), parity=True)
    known = known.join(keep(sharp, "sharp"), "lid").join(classes.withColumnRenamed("node", "lid"), "lid", "left")
    known = keep(known.select("bucket", "lid", "sketch", F.coalesce("root", "lid").alias("root")), "known")
    for anchors in (*ANCHORS, None):
        more = unsettled(known, similarity, anchors, keep).join(tried.select("a", "b"), ["a", "b"], "left_anti")
        extra = keep(verified(more, lines, similarity, set_of, keep), "links")
        roots = known.select("lid", "root").distinct()
        between = extra.join(roots.select(F.col("lid").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("lid").alias("b"), F.col("root").alias("rb")), "b")
        # Links between lines join their whole classes.
        tops = keep.own(connected_components(between.select("ra", "rb"), "ra", "rb"))
        alone = tops.join(classes, "node", "left_anti").select("node", F.col("node").alias("root"))
        classes = keep(_merged(classes.unionByName(alone), tops), "classes")
        if anchors is not None:
            known = keep(_merged(known, tops), "known")
    out = classes.select("node", "root")
    out = materialize(out, "classes")
    keep.clear()
    return out


def _heads(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """``(lid, proof, head)``: where the line stands that stays for each line that has a copy or a link."""
    table = LineTable(docs, id_col, text_col)
    classes = links(table.lines, similarity)
    named = table.lines.select("lid", "proof", "first", "n").join(classes.withColumnRenamed("node", "lid"), "lid", "left")
    affected = materialize(named.where("root is not null or n > 1").select("lid", "proof", "first", F.coalesce("root", "lid").alias("root")), "affected")
    heads = materialize(affected.groupBy("root").agg(F.min("first").alias("head")), "heads")
    decided = affected.join(heads, "root").select("lid", "proof", "head")
    if table.clashes.limit(1).count():
        # Different lines of one name are linked to equal ones only.
        own = _named(lines_of(docs, id_col, text_col)).join(table.clashes, "lid", "left_semi")
        decided = decided.unionByName(own.groupBy("lid", "proof").agg(F.min("at").alias("head")))
    decided = materialize(decided, "decided")
    discard(classes, affected, heads)
    table.drop()
    return decided


def _judged(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """``(at, head)`` of every line of every row; the line stays if both are the same."""
    heads = _heads(docs, id_col, text_col, similarity)
    return _named(lines_of(docs, id_col, text_col)).join(heads, ["lid", "proof"], "left").select("at", F.coalesce("head", "at").alias("head"))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, line_no, first_doc, first_line, kept)`` for every line of every row of ``docs``.

    ``first_doc`` and ``first_line`` name the earliest line of its class, the
    one that stays.  Blank lines are classes of their own and stay, so a null
    or empty text keeps its one empty line; lines too short for a shingle are
    linked to equal ones only.  Lines of any length and texts of any number of
    lines are read whole.  Rows that agree in id and text are one document,
    whose lines stay or go on all of them; rows without an id sort before all
    others.  An empty table has no lines; other columns are ignored.
    """
    judged = _judged(docs, id_col, text_col, similarity)
    return judged.select("at.doc_id", "at.line_no", F.col("head.doc_id").alias("first_doc"), F.col("head.line_no").alias("first_line"), F.col("head").eqNullSafe(F.col("at")).alias("kept"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the lines that ``line_classes`` keeps, in order and with their own spelling.

    Documents of which no line but blank ones is left go; those without a
    duplicate line are untouched.  Rows that share an id but not the text lose
    their own lines only.  Rows without an id can't be named, so they stay as
    they are.  ``n_chars``, where ``docs`` has it, follows the text; columns of
    any other name pass through.  An empty table stays empty.
    """
    named = docs.where(F.col(id_col).isNotNull())
    gone = _judged(named, id_col, text_col, similarity).where(~F.col("head").eqNullSafe(F.col("at")))
    gone = materialize(gone.groupBy(F.col("at.doc_id").alias("id"), F.col("at.copy").alias("copy")).agg(F.collect_set("at.line_no").alias("lines")), "gone")
    rows = named.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("copy"), F.struct(*docs.columns).alias("row"))
    # What goes has no bound on its size, so it is never broadcast.
    met = rows.join(gone.hint("merge"), ["id", "copy"], "left")
    own = F.col("row")[text_col]
    left = F.filter(F.transform(F.split(own, "\n", -1), lambda x, i: F.when(~F.array_contains("lines", i), x)), lambda x: x.isNotNull())
    met = met.select("row", F.when(F.col("lines").isNotNull(), left).alias("left"))
    met = met.where(F.col("left").isNull() | F.exists("left", lambda x: F.length(F.trim(x, F.lit(_BLANK))) > 0))
    text = F.when(F.col("left").isNull(), own).otherwise(F.array_join("left", "\n"))
    changed = {text_col: text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("left").isNull(), F.col("row")["n_chars"]).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return met.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns)).unionByName(docs.where(F.col(id_col).isNull()))
