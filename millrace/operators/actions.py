"""Actions, kept results, and values shared between driver and tasks."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark import AccumulatorParam, Broadcast, StorageLevel
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from millrace.operators.keyed import REDUCERS, Keys, as_columns, upsert
from millrace.storage import Folder, checkpoint_dir, scratch


class TooLarge(RuntimeError):
    """More would go to the driver or to every executor than the limit allows."""


# --- data in and kept ---


def parallelize(spark: SparkSession, rows: Iterable, schema: str, partitions: int | None = None) -> DataFrame:
    """A table of the driver's rows (single values become one column)."""
    listed = [r if isinstance(r, (tuple, list, dict, Row)) else (r,) for r in rows]
    made = spark.createDataFrame(listed, schema)
    return made.repartition(partitions) if partitions else made


@contextmanager
def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """``df`` kept on the executors while the block runs, and released after it."""
    kept = df.persist(level)
    try:
        yield kept
    finally:
        kept.unpersist()


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut, in the shared checkpoint folder (which outlives executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """What is stored at ``path``; if nothing is yet, ``df`` is written there first."""
    if not Folder(df.sparkSession, path).has("_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- actions ---


def foreach(df: DataFrame, function: Callable[[Row], None]) -> None:
    """Call ``function`` for each row, on the executors."""
    df.foreach(function)


def foreach_partition(df: DataFrame, function: Callable[[Iterator[Row]], None]) -> None:
    """Call ``function`` for the rows of each partition, on the executors."""
    df.foreachPartition(function)


def reduce_to_driver(df: DataFrame, keys: Keys, value: str | Column, how: str | Callable[[Column], Column], most: int = 1_000_000) -> dict:
    """Reduced values by key as a dict. Rows are combined on the executors; more than ``most`` keys
    are an error."""
    columns = as_columns(keys)
    reducer = REDUCERS[how] if isinstance(how, str) else how
    found = df.groupBy(*columns).agg(reducer(as_columns(value)[0]).alias("__v")).limit(most + 1).collect()
    if len(found) > most:
        raise TooLarge(f"more than {most} keys")
    return {(r[0] if len(columns) == 1 else tuple(r)[:-1]): r["__v"] for r in found}


def fold(df: DataFrame, value: str | Column, zero: Column, merge: Callable[[Column, Column], Column], combine: Callable[[Column, Column], Column] | None = None, name: str = "value") -> DataFrame:
    """One row: all values folded in chunks from ``zero``, and the chunks' results combined (by
    default with ``merge``). An empty table gives ``zero``."""
    from millrace.operators.keyed import fold_by_key

    made = fold_by_key(df, F.lit(1).alias("__one"), value, zero, merge, name=name, combine=combine or merge)
    empty = df.sparkSession.range(1).select(zero.alias(name))
    return made.select(name).unionByName(empty.join(made.limit(1).select(F.lit(1).alias("__some")), F.lit(True), "left_anti"))


def on_partitions(df: DataFrame, partitions: Sequence[int], function: Callable, schema: str) -> DataFrame:
    """An opaque function over the pandas frames of the chosen partitions only."""
    return df.filter(F.spark_partition_id().isin(list(partitions))).mapInPandas(function, schema)


def map_partitions_with(df: DataFrame, function: Callable, schema: str, cpus: int = 1) -> DataFrame:
    """An opaque function over an iterator of pandas frames, in tasks that take ``cpus`` cores. A
    local session has no task resources and ignores them."""
    if cpus == 1 or df.sparkSession.sparkContext.master.startswith("local"):
        return df.mapInPandas(function, schema)
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(cpus)).build
    return df.mapInPandas(function, schema, profile=profile)


# --- shared values ---


def shared_value(spark: SparkSession, value, limit_bytes: int = 256 << 20) -> Broadcast:
    """``value`` on every executor, once; an error if it is larger than the limit when pickled."""
    size = len(pickle.dumps(value, protocol=pickle.HIGHEST_PROTOCOL))
    if size > limit_bytes:
        raise TooLarge(f"{size} bytes are more than {limit_bytes}; join a table instead")
    return spark.sparkContext.broadcast(value)


class Totals:
    """Aggregates that are gathered while an action runs over ``df``: exact once, unlike
    accumulators, which count again where a task is retried."""

    def __init__(self, df: DataFrame, **aggregates: Column):
        self.observation = Observation(f"totals-{uuid.uuid4().hex}")
        self.df = df.observe(self.observation, *[c.alias(n) for n, c in aggregates.items()])

    def get(self) -> dict:
        """After an action over ``self.df``."""
        return self.observation.get


class Merging(AccumulatorParam):
    """How an accumulator of lists, sets or dicts starts on a task and joins the driver's."""

    def zero(self, value):
        return type(value)()

    def addInPlace(self, a, b):
        if isinstance(a, list):
            a.extend(b)
        else:
            a.update(b)
        return a


def accumulator(spark: SparkSession, start):
    """A value that tasks add to: a number, list, set or dict. What retried tasks add may count
    twice; use ``Totals`` where that matters."""
    return spark.sparkContext.accumulator(start, None if isinstance(start, (int, float, complex)) else Merging())


class SharedMap:
    """A keyed table with versions. Readers of a version are not disturbed by later writes; values
    that one write gives the same key more than once are kept together as conflicts."""

    def __init__(self, spark: SparkSession, key_type: str = "string", value_type: str = "string", path: str | None = None):
        self.spark, self.schema = spark, f"k {key_type}, v array<{value_type}>"
        self.folder = Folder(spark, path or f"{scratch(spark)}/map-{uuid.uuid4().hex}").make()

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.folder.names() if n.isdigit() and self.folder.has(f"{n}/_SUCCESS"))

    def table(self, version: int | None = None) -> DataFrame:
        """k and v: the values of a version (by default the last one); one value unless in conflict."""
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder.path}/{found[-1] if version is None else version}")

    def put(self, rows: DataFrame | Mapping) -> int:
        """Write a new version with these keys' values; a NULL value deletes its key."""
        if not isinstance(rows, DataFrame):
            pairs = self.schema.replace("array<", "").replace(">", "")
            rows = self.spark.createDataFrame(list(rows.items()), pairs)
        fresh = rows.toDF("k", "v").groupBy("k").agg(F.array_sort(F.collect_set("v")).alias("v"))
        after = upsert(self.table(), fresh, "k", "v").filter(F.size("v") > 0)
        number = (self.versions() or [0])[-1] + 1
        after.write.parquet(f"{self.folder.path}/{number}")
        return number

    def get(self, key):
        """A key's value, a list of them in conflict, or None. The filter reaches the scan."""
        row = self.table().filter(F.col("k") == F.lit(key)).head()
        return None if row is None else row["v"][0] if len(row["v"]) == 1 else list(row["v"])
