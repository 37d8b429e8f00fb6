"""Windows over streams and, with the same functions, over tables.

Windows are event-time windows [start, end). ``closed="right"`` gives (start, end] by moving times
one microsecond back. A stream should carry a watermark (``with_watermark``) where its windows are
to be emitted once and their state dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICRO = "INTERVAL 1 MICROSECOND"


def with_watermark(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Rows later than ``delay`` behind the latest may be dropped. Local times become instants."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def window(df: DataFrame, ts: str, duration: str, slide: str | None = None, start: str | None = None, closed: str = "left") -> Column:
    """The window of each row (several, if windows overlap)."""
    if closed not in ("left", "right"):
        raise ValueError("closed is left or right")
    time = F.col(ts) - F.expr(MICRO) if closed == "right" else F.col(ts)
    return F.window(time, duration, slide or duration, start)


def aggregate_by_window(df: DataFrame, ts: str, duration: str, aggregates: dict[str, Column], keys: tuple[str, ...] = (), slide: str | None = None, start: str | None = None, closed: str = "left") -> DataFrame:
    """w (the window's start), keys and aggregates."""
    # The time column may be needed under its own name by the watermark, so the shift is inline.
    grouped = df.groupBy(window(df, ts, duration, slide, start, closed).alias("__w"), *keys)
    return grouped.agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("__w.start").alias("w"), *keys, *aggregates)


def tumble(df: DataFrame, ts: str, duration: str, aggregates: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """Windows that follow each other."""
    return aggregate_by_window(df, ts, duration, aggregates, keys)


def count_by_window(df: DataFrame, ts: str, duration: str, slide: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    return aggregate_by_window(df, ts, duration, {"n": F.count("*")}, keys, slide)


def zero_filled(counts: DataFrame, step: str, keys: tuple[str, ...] = (), value: str = "n") -> DataFrame:
    """Finished window counts with a 0 for each window between the first and the last that has no
    row, for every key seen: what windows that are updated by an inverse function keep."""
    # min and max are one row; each key is given the series of windows, which grows with time.
    span = F.broadcast(counts.agg(F.min("w").alias("lo"), F.max("w").alias("hi")).filter("lo IS NOT NULL"))
    known = counts.select(*keys).distinct().crossJoin(span) if keys else span
    grid = known.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {step}"))).alias("w"), *keys)
    return grid.join(counts, ["w", *keys], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0).cast(dict(counts.dtypes)[value])))


def stream_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, duration: str, kind: str = "inner") -> DataFrame:
    """Rows of two streams with equal keys in the same window (watermarks bound the state)."""
    a = left.withColumn("__w", F.window(left_ts, duration))
    b = right.withColumn("__w", F.window(right_ts, duration))
    return a.join(b, [*keys, "__w"], kind).withColumn("w", F.col("__w.start")).drop("__w")


def stream_cogroup(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, duration: str, left_value: str, right_value: str) -> DataFrame:
    """w, keys, lefts, rights: for each window and key the sorted values of both streams (an empty
    list where one has none). Both are tagged, united and grouped once."""
    tagged = lambda df, ts, value, side: df.select(F.col(ts).alias("__ts"), *keys, F.lit(side).alias("__side"), F.col(value).alias("__v"))
    both = tagged(left, left_ts, left_value, 0).unionByName(tagged(right, right_ts, right_value, 1))
    lists = [F.array_sort(F.collect_list(F.when(F.col("__side") == i, F.col("__v")))).alias(n) for i, n in enumerate(("lefts", "rights"))]
    return both.groupBy(F.window("__ts", duration).alias("__w"), *keys).agg(*lists).select(F.col("__w.start").alias("w"), *keys, "lefts", "rights")


def window_slice(results: DataFrame, begin: str, end: str) -> DataFrame:
    """The results whose window starts after ``begin`` and not after ``end``."""
    return results.filter((F.col("w") > F.lit(begin).cast("timestamp")) & (F.col("w") <= F.lit(end).cast("timestamp")))


def with_static(stream: DataFrame, table: DataFrame, keys: list[str], kind: str = "inner") -> DataFrame:
    """Each micro-batch joined with the same table, as a stream that gives it in every batch."""
    return stream.join(table, keys, kind)


def transform(df: DataFrame, function: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A DataFrame function applied to the stream."""
    return df.transform(function)
