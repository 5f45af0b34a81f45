"""Bloom filters over keys, built and probed by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a word of the filter, and the most hashes of a key.
WORD, MOST_HASHES = 64, 8


def hash_count(bits: int, keys: int) -> int:
    """Hashes with the least false positives for so many keys, between 1 and 8."""
    return min(MOST_HASHES, max(1, round(0.6931 * bits / max(1, keys))))


def _places(key: Column, bits: int, hashes: int) -> Column:
    """The key's bits, by double hashing."""
    text = key.cast("string")
    # 40 bits of two hashes, whose sums can't overflow; an odd step misses no place of a power of two.
    short = lambda h: F.shiftrightunsigned(h, 24)
    first, step = short(F.xxhash64(text)), short(F.xxhash64(F.lit(1), text)).bitwiseOR(F.lit(1))
    return F.array(*(F.pmod(first + step * i, F.lit(bits)) for i in range(hashes)))


def build(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """One row ``words``: the filter of all values of ``k``, of which nulls are left out; ``bits`` bounds its size."""
    bit = F.explode(_places(F.col("k"), bits, hashes)).alias("bit")
    words = keys.where(F.col("k").isNotNull()).select(bit).select(F.floor(F.col("bit") / WORD).alias("word"), F.expr(f"shiftleft(1L, cast(bit % {WORD} as int))").alias("mask"))
    merged = words.groupBy("word").agg(F.bit_or("mask").alias("mask"))
    return merged.agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("words"))


def may_contain(keys: DataFrame, words: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``keys`` with ``may``: false only if ``k`` is certainly not in the filter; null for a null."""
    held = F.col("words")
    is_set = lambda p: F.coalesce(F.element_at(held, F.floor(p / WORD)), F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (p % WORD).cast("int"))) != 0
    # One row of at most ``bits`` bits, so its broadcast is bounded.
    met = keys.crossJoin(F.broadcast(words))
    may = F.forall(_places(F.col("k"), bits, hashes), is_set)
    return met.withColumn("may", F.when(F.col("k").isNotNull(), may)).drop("words")
