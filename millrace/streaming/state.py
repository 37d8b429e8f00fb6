"""State across micro-batches, and running streams to their end.

Structured Streaming calls state code only for keys that have rows or timers. Here, as the engine's
users expect, *every known key* is updated in each batch: state is a table, outer-joined with the
batch by key and written anew for each batch id. A batch that is replayed after a failure starts
from the same earlier version, so results are exactly once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.storage import Folder, scratch


class Versions:
    """Tables numbered by batch in one shared folder; the last two are kept."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.schema = spark, schema
        self.folder = Folder(spark, folder).make()

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in self.folder.names() if n.isdigit() and self.folder.has(f"{n}/_SUCCESS"))

    def read(self, batch: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder.path}/{batch}")

    def before(self, batch: int) -> DataFrame:
        """The latest version older than a batch."""
        older = [n for n in self.numbers() if n < batch]
        return self.read(older[-1]) if older else self.spark.createDataFrame([], self.schema)

    def latest(self) -> DataFrame:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else self.spark.createDataFrame([], self.schema)

    def put(self, batch: int, frame: DataFrame) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{self.folder.path}/{batch}")
        for n in self.numbers()[:-2]:
            self.folder.drop(str(n))
        return self.read(batch)


def update_state_by_key(stream: DataFrame, key: str, value: str, update: Callable[[Column, Column], Column], folder: str, key_type: str, value_type: str, state_type: str, sink: Callable[[DataFrame, int], None] | None = None):
    """A started-to-be writer whose state is ``update(values, state)`` for every known key.

    ``values`` is the array of the batch's values (empty for a key without rows), ``state`` the
    former state (NULL at first); a NULL result drops the key. ``sink(state, batch)`` sees the
    whole state after each batch. Rows with a NULL key only mark a batch.
    """
    spark = stream.sparkSession
    versions = Versions(spark, f"{folder}/state", f"k {key_type}, s {state_type}")

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.collect_list(F.col(value).cast(value_type)).alias("v"))
        joined = versions.before(number).join(rows, "k", "full")
        values = F.coalesce("v", F.array().cast(f"array<{value_type}>"))
        after = joined.select("k", update(values, F.col("s")).cast(state_type).alias("s")).filter("s IS NOT NULL")
        made = versions.put(number, after)
        if sink:
            sink(made, number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")


def reduce_by_key_and_window(stream: DataFrame, key: str, value: str, batches: int, folder: str, key_type: str, value_type: str, keep_zero: bool, every: int = 1, sink: Callable[[DataFrame, int], None] | None = None):
    """Sums by key over the last ``batches`` micro-batches, every ``every`` batches.

    Each batch is reduced once to a partial; a window adds its partials up. With ``keep_zero``, a
    key once seen stays with 0 after its rows have left the window, as when windows are updated
    with an inverse function; without, it goes.
    """
    spark = stream.sparkSession
    partials = Folder(spark, f"{folder}/partials").make()
    seen = Versions(spark, f"{folder}/seen", f"k {key_type}")
    schema = f"k {key_type}, p {value_type}"

    def step(batch: DataFrame, number: int) -> None:
        path = f"{partials.path}/{number}"
        reduced = batch.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.sum(value).cast(value_type).alias("p"))
        reduced.write.mode("overwrite").parquet(path)
        there = [int(n) for n in partials.names() if n.isdigit()]
        for old in (n for n in there if n <= number - batches - 1):
            partials.drop(str(old))
        inside = [f"{partials.path}/{n}" for n in there if number - batches < n <= number]
        sums = spark.read.schema(schema).parquet(*inside).groupBy("k").agg(F.sum("p").cast(value_type).alias("v"))
        if keep_zero:
            known = seen.put(number, seen.before(number).unionByName(spark.read.schema(schema).parquet(path).select("k")).distinct())
            sums = known.join(sums, "k", "left").select("k", F.coalesce("v", F.lit(0).cast(value_type)).alias("v"))
        if sink and (number + 1) % every == 0:
            sink(sums, number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")


def for_each_batch(stream: DataFrame, function: Callable[[DataFrame, int], None], folder: str):
    """A started-to-be writer that gives each micro-batch and its number to ``function``. A batch
    that is replayed after a failure comes with the same number."""
    return stream.writeStream.foreachBatch(function).option("checkpointLocation", f"{folder}/checkpoint")


def to_end(frame: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over all data that is there and return its result as a table.

    ``complete`` keeps the last result, ``append`` and ``update`` all emitted rows. Rows go to
    Parquet, not to the driver."""
    spark = frame.sparkSession
    folder = folder or f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{folder}/out"

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else f'batch={number}'}")

    frame.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    made = spark.read.schema(frame.schema).option("recursiveFileLookup", True).parquet(out)
    return made
