"""Approximate aggregates, mergeable where they are kept, and bitmap algebra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def adcount(df: DataFrame, column: str | Column, rsd: float = 0.01) -> DataFrame:
    """Approximate number of distinct values: one row, ``n``."""
    return df.agg(F.approx_count_distinct(column, rsd).alias("n"))


def adcount_by_key(df: DataFrame, key: str, column: str | Column, rsd: float = 0.01) -> DataFrame:
    return df.groupBy(key).agg(F.approx_count_distinct(column, rsd).alias("n"))


def distinct_sketch(df: DataFrame, keys: Sequence[str], column: str, lg_k: int = 14) -> DataFrame:
    """keys, sketch: stored distinct counts that later runs can merge."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(column, lg_k).alias("sketch"))


def merge_distinct(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n: distinct counts of merged sketches."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def _quantiles(value: str | Column, p: Sequence[float], exact: bool, accuracy: int) -> Column:
    if any(not 0 <= x <= 100 for x in p):
        raise ValueError("percentiles lie between 0 and 100")
    shares = F.array(*[F.lit(x / 100) for x in p])
    return (F.percentile(value, shares) if exact else F.percentile_approx(value, shares, accuracy)).alias("percentiles")


def percentiles(df: DataFrame, value: str | Column, p: Sequence[float], exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """One row with the array ``percentiles``, p in 0 to 100; a bounded sketch unless ``exact``."""
    return df.agg(_quantiles(value, p, exact, accuracy))


def percentiles_by_key(df: DataFrame, key: str, value: str | Column, p: Sequence[float], exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    return df.groupBy(key).agg(_quantiles(value, p, exact, accuracy))


def quantile_sketch(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, sketch: stored quantile sketches that later runs can merge."""
    return df.groupBy(*keys).agg(F.expr(f"kll_sketch_agg_double(CAST(`{value}` AS DOUBLE))").alias("sketch"))


def bitmap(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """keys, bucket, bits: positions as bitmaps of 32768 bits.

    Distinct positions are shuffled and sorted, not bitmaps: by the first key and bucket, then by the
    other keys. So bitmaps are made one after the other, and a union over the first keys, in their
    order, takes them as they come."""
    first, rest = list(keys[:1]), list(keys[1:])
    marks = df.select(*keys, F.bitmap_bucket_number(position).alias("bucket"), F.bitmap_bit_position(position).alias("__bit")).distinct()
    ranked = marks.repartition(*first, "bucket").groupBy(*first, "bucket", *rest)
    return ranked.agg(F.bitmap_construct_agg("__bit").alias("bits")).select(*keys, "bucket", "bits")


def bitmap_union(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bitmaps united over rows with equal keys and bucket."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def positions(df: DataFrame, how: str, other: DataFrame, column: str = "pos") -> DataFrame:
    """Set algebra on positions: intersect, union, xor or except."""
    a, b = df.select(column), other.select(column)
    if how == "intersect":
        return a.intersect(b)
    if how == "union":
        return a.union(b).distinct()
    if how == "except":
        return a.subtract(b)
    if how == "xor":
        return a.subtract(b).union(b.subtract(a))
    raise ValueError("how is intersect, union, xor or except")


def bloom_parameters(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter for n values at error rate p."""
    import math

    if n <= 0 or not 0 < p < 1:
        raise ValueError("n is positive and p between 0 and 1")
    bits = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return bits, max(1, round(bits / n * math.log(2)))
