"""Quality rules: fixed base limits and robust multivariate outliers.

Statistics of each text are transformed to a vector; per language and source
the minimum-covariance-determinant (MCD) estimate of its centre and scatter is
sought by concentration steps over all rows from several starts, of which the
one that ends with the least determinant counts.  A vector whose Mahalanobis
distance from the centre is beyond a chi-square quantile is rejected.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import chi2_cdf, chi2_quantile, text_or_empty
from millrace.sources.storage import discard, materialize

#: Contract: limits of the base rules.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Share of a group's rows in the concentrated part (so over a third of them may be outliers), steps of every start, and of the best one after them.
SUPPORT, STEPS, LAST_STEPS = 0.65, 3, 3
#: Starts of a group: the first from its medians, the others from a few of its rows.
STARTS = 4
#: Rows that the estimate of the group around it counts for in a group's own.
PRIOR_ROWS = 200
#: Copies of a group's estimate, each of which meets a share of the group's rows.
SALTS = 16
#: A vector is an outlier beyond this chi-square quantile.
QUANTILE = 0.995
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\r\x0b\x0c"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())

#: Each transformed statistic with the least standard deviation that it is granted: below it
#: a spread says that a statistic is rounded or mostly zero, not that every difference matters.
FEATURES = (("f_length", 0.08), ("f_symbols", 0.06), ("f_lines", 0.30), ("f_repeats", 0.30), ("f_marks", 0.06), ("f_upper", 0.08))
NAMES = [name for name, _ in FEATURES]


def statistics(text: str | None) -> tuple:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_marks, n_upper)`` of a whole text."""
    if not text:
        return (0,) * 8
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    word_chars = len(text) - sum(map(text.count, _SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            reach = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 3 - max(reach, i)
                    reach = i + 3
    marks = len(raw) - len(raw.translate(None, _PUNCTUATION))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeated, len(lines), marks, upper


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper"]


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``(id, g0, g1, ..., BASE...)``: group keys and statistics of every row; a null text has none of anything."""

    def run(batches):
        for batch in batches:
            found = np.array([statistics(x) for x in batch.column(0).to_pylist()], np.int64).reshape(-1, len(BASE))
            columns = [*batch.columns[1:], *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(BASE)))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[1:], *BASE])

    # A null is a group of its own, under a name that no value can have.
    groups = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")).alias(f"g{i}") for i, c in enumerate(group_cols)]
    source = docs.select(text_or_empty(text_col).alias("text"), F.col(id_col).alias("id"), *groups)
    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]] + [f"{n} bigint" for n in BASE])
    return source.mapInArrow(run, kind)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def transformed() -> list[Column]:
    """The vector: logarithms of ratios, and angles of shares, whose spread doesn't hang on their level."""
    share = lambda part, whole: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.lit(1), F.col(whole)))))
    return [
        F.log(F.greatest(F.lit(1), F.col("word_chars")) / F.greatest(F.lit(1), F.col("n_words"))).alias("f_length"),
        F.log1p(F.col("n_symbols") / F.greatest(F.lit(1), F.col("n_words"))).alias("f_symbols"),
        share("n_dup_lines", "n_lines").alias("f_lines"),
        share("n_repeat_words", "n_words").alias("f_repeats"),
        share("n_marks", "word_chars").alias("f_marks"),
        share("n_upper", "word_chars").alias("f_upper"),
    ]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, sums and sums of products per group: partial sums, a row for each group and task."""
    p = len(NAMES)
    sums = [F.sum(n).alias(f"s{i}") for i, n in enumerate(NAMES)]
    products = [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q{i}_{j}") for i in range(p) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def _entries() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def _floor() -> np.ndarray:
    return np.diag([scale**2 for _, scale in FEATURES])


def _matrix(at: dict, name: str) -> np.ndarray:
    """Symmetric matrices, one for each row, from the columns of their entries."""
    p = len(NAMES)
    out = np.zeros((len(at["n"]), p, p))
    for i, j in _entries():
        out[:, i, j] = out[:, j, i] = np.array(at[f"{name}{i}_{j}"], float)
    return out


def _estimate(at: dict, keys: list[str], n: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> pa.RecordBatch:
    """Keys, rows, centre, scatter, its inverse and its log determinant."""
    inverse = np.linalg.inv(cov)
    columns = [at[k] for k in keys] + [pa.array(n.astype(np.int64)), pa.array(np.linalg.slogdet(cov)[1])] + [pa.array(np.ascontiguousarray(mean[:, i])) for i in range(len(NAMES))]
    columns += [pa.array(np.ascontiguousarray(x[:, i, j])) for x in (cov, inverse) for i, j in _entries()]
    return pa.RecordBatch.from_arrays(columns, [*keys, *ESTIMATE])


ESTIMATE = ["n", "logdet", *(f"m{i}" for i in range(len(NAMES))), *(f"{x}{i}_{j}" for x in "cw" for i, j in _entries())]


def _kind(df: DataFrame, keys: list[str]) -> str:
    return ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + ["n bigint"] + [f"{x} double" for x in ESTIMATE[1:]])


def _fit(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Centre, scatter, its inverse and log determinant from the moments of each group."""
    p = len(NAMES)
    # The scatter of the innermost share of a normal cloud is too small by this factor.
    factor = SUPPORT / chi2_cdf(chi2_quantile(SUPPORT, p), p + 2)

    def run(batches):
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n = np.array(at["n"], float)
            mean = np.stack([np.array(at[f"s{i}"], float) / n for i in range(p)], 1)
            cov = _matrix(at, "q") / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
            values, vectors = np.linalg.eigh(cov)
            cov = np.einsum("nij,nj,nkj->nik", vectors, np.maximum(values, 0), vectors) * factor + _floor()
            yield _estimate(at, keys, n, mean, cov)

    # A row for each group: a few tasks do, and few workers have to come up for them.
    return moments.coalesce(SALTS).mapInArrow(run, _kind(moments, keys))


def _shrunk(own: DataFrame, around: DataFrame, keys: list[str]) -> DataFrame:
    """Each group's estimate mixed with that of the group around it, which counts for ``PRIOR_ROWS`` rows; the fewer rows, the nearer to it."""
    p = len(NAMES)
    both = own.join(around.select(F.col("key").alias("around"), *(F.col(x).alias(f"o_{x}") for x in ESTIMATE)), "around")

    def run(batches):
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            outer = {k.removeprefix("o_"): v for k, v in at.items() if k.startswith("o_")}
            n = np.array(at["rows"], float)
            w = (n / (n + PRIOR_ROWS))[:, None]
            mine, theirs = (np.stack([np.array(x[f"m{i}"], float) for i in range(p)], 1) for x in (at, outer))
            gap = mine - theirs
            cov = w[:, :, None] * _matrix(at, "c") + (1 - w)[:, :, None] * _matrix(outer, "c") + (w * (1 - w))[:, :, None] * gap[:, :, None] * gap[:, None, :]
            yield _estimate(at, keys, n, w * mine + (1 - w) * theirs, cov)

    return both.coalesce(SALTS).mapInArrow(run, _kind(own, keys))


def _distance() -> Column:
    total = F.lit(0.0)
    for i in range(len(NAMES)):
        for j in range(i + 1):
            term = F.col(f"w{i}_{j}") * (F.col(NAMES[i]) - F.col(f"m{i}")) * (F.col(NAMES[j]) - F.col(f"m{j}"))
            total = total + (term if i == j else 2 * term)
    return total


def _met(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what ``small`` has for their group.  Both are dealt by group and ``salt``, so no group is one task."""
    return rows.join(small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt"])


def _concentrated(rows: DataFrame, fit: DataFrame, keys: list[str], share: float) -> DataFrame:
    """One concentration step: the estimate of the rows nearest to an estimate, a ``share`` of each group."""
    measured = _met(rows, fit.select(*keys, *(x for x in ESTIMATE if x[0] in "mw")), keys).select(*keys, "salt", *NAMES, _distance().alias("d"))
    radius = measured.groupBy(*keys).agg(F.percentile_approx("d", share, 10_000).alias("radius"))
    return materialize(_fit(_moments(_met(measured, radius, keys).where("d <= radius"), keys), keys), "estimates")


def mcd_estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The MCD estimate of every group of ``keys`` from rows with the ``NAMES`` columns.

    One start takes the half of the rows nearest to the coordinatewise median
    in the features' least scales; the others the half nearest to a few rows
    (one more than there are features) with the least hashes.  Each is followed
    for ``STEPS`` steps: measure all rows of the group, keep the ``SUPPORT``
    nearest, fit.  The start with the least determinant is followed for
    ``LAST_STEPS`` more.  Medians and the radius of the support come from
    mergeable quantile sketches over all rows, the fit from sums, so no group
    is ever gathered in one task.
    """
    p, own = len(NAMES), [*keys, "start"]
    dealt = materialize(rows.select(*keys, *NAMES, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")), "dealt")
    centres = dealt.groupBy(*keys).agg(*(F.percentile_approx(n, 0.5, 10_000).alias(f"m{i}") for i, n in enumerate(NAMES)))
    scale = [F.lit(1 / scale**2 if i == j else 0.0).alias(f"w{i}_{j}") for i, j in _entries() for scale in [FEATURES[i][1]]]
    middle = centres.select(*keys, F.lit(0).alias("start"), *(f"m{i}" for i in range(p)), *scale)
    picked = dealt.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(STARTS - 1))))
    least = Window.partitionBy(*own).orderBy(F.xxhash64("start", *NAMES), *NAMES)
    few = picked.withColumn("r", F.row_number().over(least)).where(F.col("r") <= p + 1)
    fit = middle.unionByName(_fit(_moments(few, own), own).select(*middle.columns))
    fit = materialize(fit, "starts")
    every = dealt.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    share = 0.5
    for _ in range(STEPS):
        before, fit = fit, _concentrated(every, fit, own, share)
        discard(before)
        share = SUPPORT
    best = materialize(fit.groupBy(*keys).agg(F.min_by(F.struct(*ESTIMATE), F.struct("logdet", "start")).alias("e")).select(*keys, "e.*"), "best")
    discard(fit)
    for _ in range(LAST_STEPS):
        before, best = best, _concentrated(dealt, best, keys, SUPPORT)
        discard(before)
    discard(dealt)
    return best


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``(id_col, BASE..., base_failed, distance, group_rows, kept)`` for every row of ``docs``.

    ``base_failed``: under ``MIN_WORDS`` words, or over half of them in 3-word
    windows found more than once.  The others are rejected if their squared
    Mahalanobis distance from their group's MCD centre is beyond ``QUANTILE``.
    Every group (nulls are a value of their own) has an estimate, mixed with
    that of its first column's group, and that one with the estimate of all
    rows, which count for ``PRIOR_ROWS`` rows each; ``group_rows`` says how
    many rows of its own stand beside them.  ``distance`` and ``group_rows``
    are null for rows that fail the base rules.  Null and empty texts have no
    words and fail; texts of any length are read whole.  Repeated rows are
    judged alike; other columns are ignored; an empty table has no rows.
    """
    depths = range(len(group_cols) + 1)
    stats = materialize(base_statistics(docs, id_col, text_col, group_cols).select("*", base_failed().alias("base_failed"), *transformed()), "statistics")
    limit = chi2_quantile(QUANTILE, len(NAMES))
    result = [F.col("id").alias(id_col), *BASE, "base_failed", "distance", "group_rows", F.coalesce(F.col("distance") <= limit, F.lit(False)).alias("kept")]
    failed = stats.where("base_failed").select("*", F.lit(None).cast("double").alias("distance"), F.lit(None).cast("bigint").alias("group_rows"))
    # A row's groups from that of all rows to the finest, each named with its depth.
    name = {d: F.to_json(F.array(F.lit(str(d)), *(F.col(f"g{i}") for i in range(d)))) for d in depths}
    passed = stats.where(~F.col("base_failed")).select("*", *(name[d].alias(f"k{d}") for d in depths))
    in_all = materialize(passed.select(F.explode(F.array(*(F.col(f"k{d}") for d in depths))).alias("key"), *NAMES), "vectors")
    raw = materialize(mcd_estimates(in_all, ["key"]), "raw")
    sizes = passed.groupBy(*(f"k{d}" for d in depths)).agg(F.count(F.lit(1)).alias("rows"))
    sizes = materialize(sizes, "sizes")
    settled = raw.join(sizes.select(F.col("k0").alias("key")).distinct(), "key", "left_semi")
    for d in depths[1:]:
        groups = sizes.groupBy(F.col(f"k{d}").alias("key"), F.col(f"k{d - 1}").alias("around")).agg(F.sum("rows").alias("rows"))
        settled = materialize(_shrunk(raw.join(groups, "key"), settled, ["key"]), "settled")
    discard(in_all, sizes)
    fit = settled.select("key", F.col("n").alias("group_rows"), *(x for x in ESTIMATE if x[0] in "mw"))
    dealt = passed.withColumn("key", F.col(f"k{depths[-1]}")).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    judged = _met(dealt, fit, ["key"]).withColumn("distance", _distance())
    return failed.select(*result).unionByName(judged.select(*result))


def keep_clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``docs`` without the rows that the rules reject.

    Rows that share an id stay only if all of them pass; rows without an id
    are judged among the rest but, as nothing names them, dropped only by the
    base rules.
    """
    named = docs.where(F.col(id_col).isNotNull())
    bad = materialize(judge(docs, id_col, text_col, group_cols).where(~F.col("kept")).select(id_col, "base_failed"), "rejected")
    nameless = docs.where(F.col(id_col).isNull())
    if bad.where(F.col(id_col).isNull()).limit(1).count():
        marks = base_statistics(nameless.withColumn(id_col, F.col(text_col)), id_col, text_col, group_cols).where(base_failed()).select(F.col("id").alias(text_col)).distinct()
        nameless = nameless.where(F.col(text_col).isNotNull()).join(marks, text_col, "left_anti").select(*docs.columns)
    return named.join(bad.select(id_col).distinct(), id_col, "left_anti").select(*docs.columns).unionByName(nameless)
