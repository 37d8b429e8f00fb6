"""Hashes as Columns, equal on every machine and in every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Start and prime of the 32-bit hash.
FNV_START, FNV_PRIME = 0x811C9DC5, 0x01000193


def fnv1a(value: str | Column) -> Column:
    """32-bit FNV-1a of a text's UTF-8 bytes, as a non-negative long; NULL for NULL."""
    data = F.col(value) if isinstance(value, str) else value
    digits = F.hex(data.cast("binary"))
    # Two digits a byte; an empty text has no places.
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    octets = F.transform(places, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("bigint"))
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(data.isNotNull(), F.aggregate(octets, F.lit(FNV_START).cast("bigint"), step))


def stable_hash(*values: str | Column) -> Column:
    """64-bit hash of a tuple of values of any types; NULLs count too."""
    return F.xxhash64(*values)


def bucket(n: int, *values: str | Column) -> Column:
    """A number from 0 to ``n - 1`` by the hash of a tuple."""
    return F.pmod(F.xxhash64(*values), F.lit(n)).cast("int")
