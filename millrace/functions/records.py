"""Functions of keys and records, all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Key and value bytes of a record that are still accepted.
MAX_RECORD_BYTES = 32_768


def key_bytes(key: Column) -> Column:
    """The key's bytes: those of its text for anything but binary."""
    return key.cast("string").cast("binary")


def key_prefix(key: Column) -> Column:
    """The first eight bytes as 16 hexadecimal digits, short keys filled up with zero bytes.

    Compares like the unsigned big-endian number that they spell, so it orders
    keys up to ties among longer ones.
    """
    return F.rpad(F.hex(F.substring(key_bytes(key), 1, 8)), 16, "0")


def record_bytes(key: Column, value: Column) -> Column:
    """Bytes of key and value together; a null value (a tombstone's) has none."""
    length = lambda c: F.octet_length(c.cast("string"))
    return length(key) + F.coalesce(length(value), F.lit(0))


def first_byte(key: Column) -> Column:
    """The first byte as a number from 0 to 255; 0 for an empty key."""
    return F.coalesce(F.conv(F.nullif(F.hex(F.substring(key_bytes(key), 1, 1)), F.lit("")), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key by hash; of whole numbers by remainder, so that it can be told from outside."""
    return F.pmod(key, F.lit(shards)).cast("bigint")


def hash_shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("bigint")
