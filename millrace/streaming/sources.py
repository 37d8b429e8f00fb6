"""Stream sources: growing files, rotating files, sockets, queues of batches, generators.

``tail`` emits what is appended to files, not only new files. Its offsets are file sizes (with
inodes for ``follow="name"``), kept by Spark's offset log, so a restarted query reads the same
ranges again.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from millrace.sources import vfs
from millrace.sources.binary import lines_of
from millrace.sources.vfs import local


class Piece(InputPartition):
    """Bytes of a file that were appended between two offsets."""

    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class Tail(DataSource):
    """Lines appended to files. Options:

    path: a folder, file or glob; suffix: only names that end so; follow: ``growth`` (default) for
    files of a folder, ``name`` for named files that may be rotated: another inode or a smaller size
    starts again at 0; start: ``end`` skips what is there at first (default ``begin``);
    max_age: files not changed for so many seconds are left alone; links: follow symlinks.
    """

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(dict(self.options))


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = local(options["path"])
        self.suffix = options.get("suffix", "")
        self.by_name = options.get("follow", "growth") == "name"
        self.from_end = options.get("start", "begin") == "end"
        self.max_age = float(options.get("max_age", 0))
        self.links = options.get("links", "false").lower() == "true"

    def files(self) -> list[str]:
        parts = [self.path] if vfs.isdir(self.path) else self.path.split(",")
        found = [f for part in parts for p in vfs.glob(part) if vfs.exists(p) for f in (vfs.walk(p, follow_links=self.links) if vfs.isdir(p) else [p])]
        return sorted(p for p in found if p.endswith(self.suffix) and not p.rpartition("/")[2].startswith(".") and (self.links or vfs.is_remote(p) or not os.path.islink(p)))

    @staticmethod
    def complete_size(path: str, size: int) -> int:
        """Up to the last line end, so that a line being written is left for later."""
        with vfs.open(path) as f:
            at = size
            while at > 0:
                step = min(at, 1 << 16)
                f.seek(at - step)
                end = f.read(step).rfind(b"\n")
                if end >= 0:
                    return at - step + end + 1
                at -= step
        return 0

    def sizes(self) -> dict:
        import time

        out = {}
        for p in self.files():
            try:
                s = vfs.stat(p)
            except FileNotFoundError:
                continue
            if not self.max_age or time.time() - s.changed <= self.max_age:
                out[p] = [s.identity, self.complete_size(p, s.size)]
        return out

    def initialOffset(self) -> dict:
        return self.sizes() if self.from_end else {}

    def latestOffset(self) -> dict:
        return self.sizes()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for p, (inode, size) in sorted(end.items()):
            was_inode, was = start.get(p, (inode, 0))
            again = self.by_name and was_inode != inode or size < was
            begin = 0 if again else was
            if size > begin:
                out.append(Piece(p, begin, size))
        return out

    def read(self, partition: Piece):
        yield from ((partition.path, line) for line in lines_of(partition.path, partition.begin, partition.end))

    def commit(self, end: dict) -> None:
        pass


def tail(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of (path, value) lines appended under ``path``."""
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").options(path=path, **options).load()


def text_stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """Lines of the files that appear in a folder."""
    reader = spark.readStream
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).text(path)


def socket_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


class Queue:
    """Batches handed over one at a time: each ``put`` becomes one micro-batch.

    The batches are files in a folder that is read one file per trigger; an empty batch is a file
    without rows, which still makes a trigger.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        os.makedirs(folder, exist_ok=True)

    def put(self, rows: Sequence[tuple]) -> None:
        frame = self.spark.createDataFrame(list(rows), self.schema).coalesce(1)
        part = os.path.join(self.folder, f".batch-{self.n}")
        frame.write.json(part)
        files = sorted(glob.glob(os.path.join(part, "*.json"))) or [None]
        target = os.path.join(self.folder, f"batch-{self.n:06d}.json")
        if files[0] is None:
            open(target, "w").close()
        else:
            os.replace(files[0], target)
        # Files are taken in the order of their times.
        os.utime(target, (1_000_000 + self.n, 1_000_000 + self.n))
        self.n += 1

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(os.path.join(self.folder, "batch-*.json"))


def generator_stream(spark: SparkSession, source: type[DataSource], **options) -> DataFrame:
    """A stream from a Python ``DataSource`` with a (simple) stream reader."""
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).options(**options).load()
