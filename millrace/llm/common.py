"""Helpers shared by the training-data operators.

Nothing here is imported from outside this subpackage.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a Python kernel sees at once. Bounds worker memory when texts are very long.
SLICE_ROWS = 256

#: Rows of an Arrow batch.
BATCH_ROWS = 1024

#: Largest estimated size of a side that is sent to every executor; larger sides are shuffled.
BROADCAST_BYTES = 32 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One driver table; the path may be any that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset (tests, a local session) a folder of our own is chosen; a cluster
    must name one, since executors do not see each other's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Lineage ends there, so a lost executor costs no recomputation, and the row count comes
    from file footers. The files are deleted when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` written in buckets by ``keys`` (as many as a shuffle has partitions), so that later
    joins on them move only their other side."""
    spark = df.sparkSession
    name = f"millrace_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.table(name)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_or_shuffled(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if ``rows * row_bytes`` is within ``limit``; else as it is,
    so that the join shuffles both sides. The result of the join is the same."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def held_out(doc_id: Column | str) -> Column:
    """True for the documents that no model may learn from: crc32 of the id as text, mod 4, is 2.
    A null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 4) == 2


def bounded_batches(spark: SparkSession) -> None:
    """Fewer rows an Arrow batch than Spark's default, since rows are whole texts; a setting of the
    session's own stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) in (None, "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def arrow_map(
    df: DataFrame,
    columns: Sequence[str | Column],
    schema: str | T.StructType,
    setup: Callable[[], Callable[..., Sequence[Sequence]]],
    slice_rows: int = SLICE_ROWS,
    arrow_in: bool = False,
) -> DataFrame:
    """Apply a Python kernel to Arrow batches.

    ``setup()`` runs once a task and returns the kernel; the kernel gets one Python list for each
    of ``columns`` and returns one sequence for each field of ``schema`` (any common length). With
    ``arrow_in`` it gets Arrow arrays of whole batches and does its own slicing.
    """
    bounded_batches(df.sparkSession)
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches):
        kernel = setup()
        for batch in batches:
            for start in range(0, batch.num_rows, batch.num_rows if arrow_in else slice_rows):
                part = batch.slice(start, batch.num_rows if arrow_in else slice_rows)
                out = kernel(*(part.column(i) if arrow_in else part.column(i).to_pylist() for i in range(part.num_columns)))
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(out, arrow)]
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.select(*columns).mapInArrow(run, struct)


def attach(df: DataFrame, text: str, name: str, schema: str, setup: Callable[[], Callable[[list], Sequence[Sequence]]]) -> DataFrame:
    """``df`` with a struct column ``name`` computed from the text column; all other columns stay."""
    bounded_batches(df.sparkSession)
    fields = [f.name for f in T.StructType.fromDDL(schema)]
    made: list = []

    @F.pandas_udf(schema)
    def apply(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(setup())
        values = texts.tolist()
        rows: list[list] = [[] for _ in fields]
        for start in range(0, len(values), SLICE_ROWS):
            for column, part in zip(rows, made[0](values[start : start + SLICE_ROWS])):
                column.extend(part)
        return pd.DataFrame(dict(zip(fields, rows)))

    return df.withColumn(name, apply(F.col(text)))
