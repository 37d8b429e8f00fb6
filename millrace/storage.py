"""Folders that all executors share, through Hadoop's file systems.

``spark.checkpoint.dir`` names the folder for intermediate tables. Only a local session may do
without; it gets a temporary folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The shared folder, without a slash at the end."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def checkpoint_dir(spark: SparkSession) -> None:
    """See to it that ``DataFrame.checkpoint`` has a folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch(spark))


class Folder:
    """A folder on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = ""):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def make(self) -> Folder:
        fs, place = self._at()
        fs.mkdirs(place)
        return self

    def names(self) -> list[str]:
        fs, place = self._at()
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def has(self, name: str = "") -> bool:
        fs, place = self._at(name)
        return fs.exists(place)

    def size(self, name: str) -> int:
        fs, place = self._at(name)
        return fs.getFileStatus(place).getLen()

    def drop(self, name: str = "") -> None:
        fs, place = self._at(name)
        fs.delete(place, True)

    def drop_at_end(self) -> None:
        """Delete it when the session's JVM ends."""
        fs, place = self._at()
        fs.deleteOnExit(place)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends there, and
    what follows sees the same rows in the same partitions whenever it runs."""
    spark = df.sparkSession
    folder = Folder(spark, f"{scratch(spark)}/table-{uuid.uuid4().hex}")
    df.write.parquet(folder.path)
    folder.drop_at_end()
    return spark.read.schema(df.schema).parquet(folder.path)
