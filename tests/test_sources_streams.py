"""Format round trips, byte ranges, logs, and streams against scripted batches."""

import os

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.sources import binary, files
from millrace.streaming import sources, state, windows


@pytest.mark.parametrize("compress", [False, True])
def test_text(spark, tmp_path, compress):
    df = spark.createDataFrame([(f"line {i}",) for i in range(1000)], "l string").repartition(3)
    written = files.write_text(df, str(tmp_path / "t"), compress=compress)
    assert written
    assert rows(files.read_text(spark, str(tmp_path / "t"))) == sorted((f"line {i}",) for i in range(1000))


def test_text_by_key_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", "x,1"), ("b", 'say "y"'), ("a", "z")], "k string, v string")
    files.write_text_by_key(df, str(tmp_path / "k"), "k", "v")
    assert rows(spark.read.text(str(tmp_path / "k" / "k=a"))) == [("x,1",), ("z",)]
    files.write_csv(df, str(tmp_path / "c"))
    assert rows(files.read_csv(spark, str(tmp_path / "c"), "k string, v string").filter("k = 'a'")) == [("a", "x,1"), ("a", "z")]


def test_expand(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("2.txt", "1.txt", ".hidden", "a/3.log", "a/b/4.txt"):
        (tmp_path / name).write_text("")
    found = [os.path.relpath(p, tmp_path) for p in files.expand(str(tmp_path), ".txt")]
    assert found == ["1.txt", "2.txt", "a/b/4.txt"]
    assert len(files.expand(str(tmp_path), max_depth=1)) == 3
    with pytest.raises(FileNotFoundError):
        files.expand(str(tmp_path / "none"))


def test_infer_delimited(spark, tmp_path):
    (tmp_path / "t").write_text("a b c\nd e f\n")
    assert rows(files.infer_delimited(spark, str(tmp_path / "t"))) == [("a", "b", "c"), ("d", "e", "f")]


def test_columnar(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("f_int"), F.concat(F.lit("s"), F.col("id") % 7).alias("f_str"), (F.col("id") / 2).alias("f_float"))
    path = str(tmp_path / "t")
    files.write_columnar(df, path, indices=["f_str"])
    assert files.read_columnar(spark, path, ["f_float", "f_int"]).columns == ["f_float", "f_int"]
    read = files.read_columnar(spark, path)
    assert files.filter_by_index(read, f_str="s3", f_int=[3, 4, 10]).count() == 2
    assert files.filter_by_index(read, f_float=lambda c: c < 1).count() == 2
    for wrong in (lambda: files.read_columnar(spark, path, ["x"]), lambda: files.filter_by_index(read, x=1), lambda: files.write_columnar(df, str(tmp_path / "u"), indices=["x"]), lambda: files.write_columnar(df, str(tmp_path / "u"), ["a", "a", "b"])):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_columnar(df, path)


def test_fixed_binary(spark, tmp_path):
    df = spark.range(10000).repartition(3)
    path = str(tmp_path / "b")
    binary.write_limited(df, "fixedbin", path, fmt="I")
    read = spark.read.format("fixedbin").options(fmt="I", split=1001).load(path)
    assert read.rdd.getNumPartitions() > 30
    assert read.agg(F.count("*"), F.sum("c0")).first()[:] == (10000, sum(range(10000)))
    (tmp_path / "raw").write_bytes(b"abcdefgh")
    assert [bytes(r[0]) for r in spark.read.format("fixedbin").options(length=3).load(str(tmp_path / "raw")).collect()] == [b"abc", b"def"]
    assert binary.fields_of("<2i4sd") == ["int", "int", "binary", "double"]
    with pytest.raises(ValueError):
        binary.fields_of("z")


def test_tfrecord(spark, tmp_path):
    values = [f"record {i} " * (i % 5) for i in range(1000)]
    path = str(tmp_path / "t")
    binary.write_limited(spark.createDataFrame([(v,) for v in values], "v string").repartition(2), "tfrecord", path)
    assert all(f.endswith(".tfrecords") for f in os.listdir(path))
    assert rows(spark.read.format("tfrecord").options(split=1024).load(path)) == sorted((v,) for v in values)


def test_tfrecord_damage(spark, tmp_path):
    good = [binary.TFRecordWriter.encode(None, (f"r{i}",)) for i in range(5)]
    broken = bytearray(good[1])
    broken[12] ^= 1
    (tmp_path / "x.tfrecords").write_bytes(good[0] + bytes(broken) + b"junk" + b"".join(good[2:]))
    binary.register_all(spark)
    assert rows(spark.read.format("tfrecord").load(str(tmp_path))) == [("r0",), ("r2",), ("r3",), ("r4",)]


def test_crc32c():
    assert binary.crc32c(b"123456789") == 0xE3069283
    assert binary.fnv1a(b"") == 0x811C9DC5


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(blacklist_characters="\r\n", blacklist_categories=("Cs",)), max_size=40), max_size=30), st.integers(1, 50))
def test_byte_ranges_cover_each_line_once(tmp_path, lines, split):
    path = tmp_path / "lines"
    path.write_bytes("".join(x + "\n" for x in lines).encode())
    size = path.stat().st_size
    found = [x for b in range(0, size, split) for x in binary.lines_of(str(path), b, min(b + split, size))]
    assert found == lines


def test_partial_text(spark, tmp_path):
    path = tmp_path / "t"
    path.write_text("".join(f"{i:03d}\n" for i in range(100)))
    binary.register_all(spark)
    read = spark.read.format("byterange").options(path=str(path), begin=100, end=300, split=37).load()
    assert rows(read) == [(f"{i:03d}",) for i in range(25, 75)]


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_kvlog(spark, tmp_path, depth):
    path = str(tmp_path / "kv")
    df = spark.createDataFrame([(str(i), i) for i in range(100)] + [("bad key", 1), ("x" * 251, 1)], "key string, value long").repartition(10)
    binary.write_limited(df, "kvlog", path, depth=depth)
    read = lambda **o: spark.read.format("kvlog").options(**o).load(path)
    assert sorted((r["key"], r["value"], r["version"]) for r in read(split=512).collect()) == sorted((str(i), str(i), 1) for i in range(100))
    assert read().filter("key = '5'").select("value").collect()[0][0] == "5"
    assert read(fullscan="true").filter(F.col("key").isin("5", "7")).count() == 2
    assert read(raw="true").filter("key = '5'").first()["flag"] == binary.INTEGER


def test_kvlog_damage_and_latest(spark, tmp_path):
    path = str(tmp_path / "kv")
    df = spark.createDataFrame([("a", "old", 1, 10), ("a", "new" * 200, 2, 20), ("b", "only", 1, 5)], "key string, value string, version int, ts int").coalesce(1)
    binary.write_limited(df, "kvlog", path)
    (file,) = [p for p in files.expand(path) if p.endswith(".data")]
    assert rows(binary.only_latest(spark.read.format("kvlog").load(path)).select("key", "version", "ts")) == [("a", 2, 20), ("b", 1, 5)]
    data = bytearray(open(file, "rb").read())
    data[0:256] = b"\xff" * 256
    open(file, "wb").write(bytes(data))
    assert rows(spark.read.format("kvlog").load(path).select("key", "version")) == [("a", 2), ("b", 1)]


# --- streams ---


def batches_of(writer, queue):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def test_state_of_idle_keys(spark, tmp_path):
    queue = sources.Queue(spark, str(tmp_path / "in"), "w string")
    for batch in ([("a",), ("a",), ("b",)], [("b",)], [(None,)], [("a",)]):
        queue.put(batch)
    seen = []
    count = lambda values, old: F.coalesce(old, F.lit(0)) + F.size(values)
    writer = state.update_state_by_key(queue.stream(), "w", "w", count, str(tmp_path / "s"), "string", "string", "int", lambda df, n: seen.append(dict(map(tuple, df.collect()))))
    batches_of(writer, queue)
    assert seen == [{"a": 2, "b": 1}, {"a": 2, "b": 2}, {"a": 2, "b": 2}, {"a": 3, "b": 2}]


def test_state_may_be_dropped(spark, tmp_path):
    queue = sources.Queue(spark, str(tmp_path / "in"), "w string")
    for batch in ([("a",), ("b",)], [("a",)], [("b",)]):
        queue.put(batch)
    seen = []
    fade = lambda values, old: F.when((F.size(values) == 0) & (F.coalesce(old, F.lit(0)) <= 1), None).otherwise(F.when(F.size(values) == 0, old - 1).otherwise(F.coalesce(old, F.lit(0)) + F.size(values)))
    writer = state.update_state_by_key(queue.stream(), "w", "w", fade, str(tmp_path / "s"), "string", "string", "int", lambda df, n: seen.append(dict(map(tuple, df.collect()))))
    batches_of(writer, queue)
    assert seen == [{"a": 1, "b": 1}, {"a": 2}, {"a": 1, "b": 1}]


def test_state_survives_a_restart(spark, tmp_path):
    queue = sources.Queue(spark, str(tmp_path / "in"), "w string")
    seen = []
    count = lambda values, old: F.coalesce(old, F.lit(0)) + F.size(values)
    for batch in ([("a",)], [("a",), ("b",)]):
        queue.put(batch)
        writer = state.update_state_by_key(queue.stream(), "w", "w", count, str(tmp_path / "s"), "string", "string", "int", lambda df, n: seen.append(dict(map(tuple, df.collect()))))
        batches_of(writer, queue)
    assert seen == [{"a": 1}, {"a": 2, "b": 1}]


@pytest.mark.parametrize(
    ("keep_zero", "expected"),
    [
        (False, [{"a": 1}, {"a": 3}, {"a": 2, "b": 1}, {"b": 1}, {}]),
        (True, [{"a": 1}, {"a": 3}, {"a": 2, "b": 1}, {"a": 0, "b": 1}, {"a": 0, "b": 0}]),
    ],
)
def test_inverse_windows(spark, tmp_path, keep_zero, expected):
    queue = sources.Queue(spark, str(tmp_path / "in"), "k string, v long")
    for batch in ([("a", 1)], [("a", 2)], [("b", 1)], [(None, 0)], [(None, 0)]):
        queue.put(batch)
    seen = []
    writer = state.reduce_by_key_and_window(queue.stream(), "k", "v", 2, str(tmp_path / "s"), "string", "bigint", keep_zero, sink=lambda df, n: seen.append(dict(map(tuple, df.collect()))))
    batches_of(writer, queue)
    assert seen == expected


def test_windows(spark):
    df = spark.createDataFrame([(i,) for i in range(8)], "s int").select(F.timestamp_seconds(F.col("s") * 2).alias("ts"))
    left = windows.count_by_window(df, "ts", "4 seconds")
    assert [r["n"] for r in left.orderBy("w").collect()] == [2, 2, 2, 2]
    right = windows.aggregate_by_window(df, "ts", "4 seconds", {"n": F.count("*")}, closed="right")
    assert [r["n"] for r in right.orderBy("w").collect()] == [1, 2, 2, 2, 1]
    gaps = df.filter("ts < timestamp_seconds(4) OR ts >= timestamp_seconds(12)")
    assert [r["n"] for r in windows.zero_filled(windows.count_by_window(gaps, "ts", "4 seconds"), "4 SECONDS").orderBy("w").collect()] == [2, 0, 0, 2]


def test_tail(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("1\n2\nunfinished")
    (folder / ".hidden.log").write_text("x\n")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def read() -> list:
        query = sources.tail(spark, str(folder), suffix=".log").writeStream.format("parquet").option("checkpointLocation", check).option("path", out).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r["value"] for r in spark.read.parquet(out).collect())

    assert read() == ["1", "2"]
    with open(folder / "a.log", "a") as f:
        f.write(" now\n3\n")
    (folder / "b.log").write_text("4\n")
    assert read() == ["1", "2", "3", "4", "unfinished now"]


def test_rotation():
    start, end = {"f": [1, 100]}, {"f": [2, 50], "g": [3, 10]}
    reader = sources.TailReader({"path": "/none", "follow": "name"})
    assert [(p.path, p.begin, p.end) for p in reader.partitions(start, end)] == [("f", 0, 50), ("g", 0, 10)]
    assert [(p.path, p.begin, p.end) for p in reader.partitions({"f": [1, 20]}, {"f": [1, 50]})] == [("f", 20, 50)]
