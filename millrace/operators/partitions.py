"""Operators that see partitions or positions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.storage import written


def enumerate_partition(df: DataFrame, name: str = "partition") -> DataFrame:
    """The partition's number beside each row."""
    return df.withColumn(name, F.spark_partition_id())


def enumerate_rows(df: DataFrame, order: Sequence[Column], name: str = "idx", first: int = 0) -> DataFrame:
    """A global consecutive number by a total order.

    Rows are range-partitioned, sorted and written with their number within the partition; a small
    table of partition sizes gives each partition its start. One shuffle, and no task sees all
    rows. Rows that are equal in the order are put by a hash of the whole row, so that many of them
    spread over partitions.
    """
    spark = df.sparkSession
    columns = [*order, F.xxhash64(*df.columns)]
    placed = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("__m", F.monotonically_increasing_id())
    # The numbering depends on where partitions begin, so the placing must not be done twice.
    placed = written(placed)
    # That id is the partition's number above 33 bits of the row's number in it.
    part = F.shiftrightunsigned("__m", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("n")).orderBy("__p").collect()
    starts, total = [], first
    for r in sizes:  # one row a partition
        starts.append((r["__p"], total))
        total += r["n"]
    base = F.broadcast(spark.createDataFrame(starts, "__p long, __start long"))
    return placed.withColumn("__p", part).join(base, "__p").withColumn(name, F.col("__start") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__p", "__start", "__m")


def batch(df: DataFrame, size: int, order: Sequence[Column], name: str = "rows") -> DataFrame:
    """Lists of ``size`` consecutive rows in an order (the last may be shorter)."""
    rows = [F.col(c) for c in df.columns]
    numbered = enumerate_rows(df, order, "__i")
    grouped = numbered.groupBy(F.floor(F.col("__i") / size).cast("bigint").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("__i", F.struct(*rows).alias("row")))).alias("x"))
    return grouped.select("batch", F.transform("x", lambda p: p["row"]).alias(name))


def batch_within_partitions(df: DataFrame, size: int) -> DataFrame:
    """Lists of at most ``size`` rows of one partition, without a shuffle."""
    fields = df.schema

    def chunks(rows):
        held = []
        for r in rows:
            held.append(tuple(r))
            if len(held) == size:
                yield (held,)
                held = []
        if held:
            yield (held,)

    schema = T.StructType([T.StructField("rows", T.ArrayType(fields))])
    return df.sparkSession.createDataFrame(df.rdd.mapPartitions(chunks), schema)


def glom(df: DataFrame, name: str = "rows") -> DataFrame:
    """One list a partition."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.collect_list(F.struct(*df.columns)).alias(name))


def slice_partitions(df: DataFrame, start: int, stop: int) -> DataFrame:
    """The rows of partitions from ``start`` up to ``stop``."""
    return df.filter((F.spark_partition_id() >= start) & (F.spark_partition_id() < stop))


def merge_split(df: DataFrame, n: int | None = None, size: int | None = None) -> DataFrame:
    """Fewer partitions by merging neighbours, without a shuffle: ``n`` of them, or ``size`` at a
    time."""
    if (n is None) == (size is None):
        raise ValueError("give n or size")
    return df.coalesce(n if n is not None else max(1, -(-df.rdd.getNumPartitions() // size)))


def sample(df: DataFrame, fraction: float, replacement: bool = False, seed: int = 12345) -> DataFrame:
    """Bernoulli (or Poisson, with replacement) sample; the same rows for the same seed."""
    return df.sample(replacement, float(fraction), seed)


def pipe(df: DataFrame, column: str, command: str, name: str = "line", check_code: bool = False) -> DataFrame:
    """Lines of a column through an external command, once a partition."""
    lines = df.select(F.col(column).cast("string")).rdd.map(lambda r: r[0] or "")
    return df.sparkSession.createDataFrame(lines.pipe(command, checkCode=check_code).map(lambda x: (x,)), f"`{name}` string")


def map_partitions_udf(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Escape hatch: an opaque function over an iterator of pandas frames."""
    return df.mapInPandas(function, schema)


class TooManyErrors(RuntimeError):
    """More records failed than the ratio allows."""


class TolerantMap:
    """A projection in which a failing record is dropped and counted.

    ``expression`` is made of ``try_`` functions, so that a failure is NULL. ``df`` is lazy;
    ``check()`` after an action raises if failures exceeded ``ratio`` of the records.
    """

    def __init__(self, df: DataFrame, name: str, expression: Column, ratio: float):
        self.ratio = ratio
        self.observation = Observation(f"tolerant-{uuid.uuid4().hex}")
        tried = df.withColumn(name, expression)
        self.df = tried.observe(self.observation, F.count(F.lit(1)).alias("total"), F.count_if(F.col(name).isNull()).alias("failed")).filter(F.col(name).isNotNull())

    def check(self) -> dict[str, int]:
        found = self.observation.get
        if found["failed"] > self.ratio * found["total"]:
            raise TooManyErrors(f"{found['failed']} of {found['total']} records failed; the ratio is {self.ratio}")
        return found


def tolerant_map(df: DataFrame, name: str, expression: Column, ratio: float = 0.0) -> TolerantMap:
    return TolerantMap(df, name, expression, ratio)
