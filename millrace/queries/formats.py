"""Format round trips: written to a scratch folder, read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from millrace.queries.basic import table
from millrace.sources import binary, files
from millrace.sql.engine import Engine
from millrace.storage import scratch


def _folder(spark, name):
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type")


def _joined(df):
    return df.select(F.concat_ws("\t", F.col("event_id").cast("string"), "event_type").alias("line"))


def _parted(df, column="value"):
    parts = F.split(column, "\t")
    return df.select(parts[0].cast("bigint").alias("event_id"), parts[1].alias("event_type"))


def text_roundtrip(spark, sf_dir):
    path = _folder(spark, "text")
    files.write_text(_joined(_pairs(spark, sf_dir)), path)
    return _parted(files.read_text(spark, path, ".txt"))


def gzip_roundtrip(spark, sf_dir):
    path = _folder(spark, "gzip")
    files.write_text(_joined(_pairs(spark, sf_dir)), path, compress=True)
    return _parted(files.read_gzip_tolerant(spark, path))


def gzip_blocks_roundtrip(spark, sf_dir):
    path = _folder(spark, "gzblocks")
    binary.write_limited(_joined(_pairs(spark, sf_dir)), "gzblocks", path, block=20_000)
    return _parted(spark.read.format("gzblocks").option("split", 10_000).load(path))


def bz2_roundtrip(spark, sf_dir):
    path = _folder(spark, "bz2")
    _joined(_pairs(spark, sf_dir)).write.option("compression", "bzip2").text(path)
    return _parted(files.read_text(spark, path, ".bz2"))


def csv_roundtrip(spark, sf_dir):
    path = _folder(spark, "csv")
    files.write_csv(_pairs(spark, sf_dir), path)
    return files.read_csv(spark, path, "event_id bigint, event_type string")


def from_csv_column(spark, sf_dir):
    lines = _pairs(spark, sf_dir).select(F.concat_ws(",", F.col("event_id").cast("string"), "event_type").alias("line"))
    return files.from_csv(lines, "line", "event_id bigint, event_type string")


def parquet_roundtrip(spark, sf_dir):
    path = _folder(spark, "columnar")
    files.write_columnar(_pairs(spark, sf_dir), path, indices=["event_type"])
    return files.read_columnar(spark, path, ["event_type", "event_id"])


def binary_roundtrip(spark, sf_dir):
    path = _folder(spark, "fixed")
    binary.write_limited(table(spark, sf_dir, "events").select("event_id", "value"), "fixedbin", path, fmt="<Id")
    read = spark.read.format("fixedbin").option("fmt", "<Id").option("split", 4096).load(path)
    return read.select(F.col("c0").alias("event_id"), F.col("c1").alias("value"))


def tfrecord_roundtrip(spark, sf_dir):
    path = _folder(spark, "tfrecord")
    binary.write_limited(_joined(_pairs(spark, sf_dir)), "tfrecord", path)
    return _parted(spark.read.format("tfrecord").option("split", 8192).load(path))


def text_by_key(spark, sf_dir):
    path = _folder(spark, "bykey")
    files.write_text_by_key(_pairs(spark, sf_dir), path, "event_type", "event_id")
    return spark.read.option("basePath", path).text(path).groupBy(F.col("event_type").alias("k")).agg(F.count("*").alias("n"))


def partial_text(spark, sf_dir):
    path = _folder(spark, "partial")
    _joined(_pairs(spark, sf_dir)).coalesce(1).write.text(path)
    binary.register_all(spark)
    one = next(p for p in files.expand(path.removeprefix("file:")) if p.endswith(".txt"))
    half = os.path.getsize(one) // 2
    parts = [spark.read.format("byterange").options(path=one, begin=b, end=e, split=5000).load() for b, e in ((0, half), (half, 1 << 40))]
    return _parted(parts[0].unionByName(parts[1]))


def filter_by_index(spark, sf_dir):
    path = _folder(spark, "indexed")
    files.write_columnar(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), path, indices=["user_id", "event_type"])
    return files.filter_by_index(files.read_columnar(spark, path), user_id=[1, 2, 3], event_type="click").select("event_id", "user_id")


def kvlog_latest(spark, sf_dir):
    path = _folder(spark, "kvlog")
    events = table(spark, sf_dir, "events")
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value"), F.col("event_id").cast("int").alias("version"), second.cast("int").alias("ts"))
    binary.write_limited(rows.coalesce(4), "kvlog", path, depth=1)
    read = binary.only_latest(spark.read.format("kvlog").option("split", 65536).load(path))
    return read.select(F.col("key").cast("bigint").alias("user_id"), F.col("value").cast("bigint").alias("e"))


def sql_create_table(spark, sf_dir):
    path = _folder(spark, "created")
    files.write_csv(_pairs(spark, sf_dir), path)
    made = Engine(spark)
    made.run(f'CREATE TABLE e (id int, kind) FROM "{path}";')
    return made.query("SELECT id AS event_id, kind AS event_type FROM e;")


def sql_outfile(spark, sf_dir):
    path = _folder(spark, "outfile")
    made = Engine(spark)
    made.register("events", table(spark, sf_dir, "events"))
    made.run(f'SELECT event_id, event_type FROM events INTO OUTFILE "{path}";')
    return files.read_csv(spark, path, "event_id bigint, event_type string")


QUERIES = {
    "text_roundtrip": text_roundtrip, "gzip_roundtrip": gzip_roundtrip, "gzip_blocks_roundtrip": gzip_blocks_roundtrip, "bz2_roundtrip": bz2_roundtrip, "csv_roundtrip": csv_roundtrip,
    "from_csv_column": from_csv_column, "parquet_roundtrip": parquet_roundtrip, "binary_roundtrip": binary_roundtrip, "tfrecord_roundtrip": tfrecord_roundtrip,
    "text_by_key": text_by_key, "partial_text": partial_text, "filter_by_index": filter_by_index, "kvlog_latest": kvlog_latest,
    "sql_create_table": sql_create_table, "sql_outfile": sql_outfile,
}

_PAIRS = "SELECT event_id, event_type FROM events"
SQL = {
    **dict.fromkeys(("text_roundtrip", "gzip_roundtrip", "gzip_blocks_roundtrip", "bz2_roundtrip", "csv_roundtrip", "from_csv_column", "parquet_roundtrip", "tfrecord_roundtrip", "partial_text", "sql_create_table", "sql_outfile"), _PAIRS),
    "binary_roundtrip": "SELECT event_id, value FROM events",
    "text_by_key": "SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1",
    "filter_by_index": "SELECT event_id, user_id FROM events WHERE user_id IN (1,2,3) AND event_type='click'",
    "kvlog_latest": "SELECT user_id, arg_max(event_id, (date_trunc('second', ts), event_id)) AS e FROM events GROUP BY 1",
}
