"""Shared values, kept results, file systems, numbering, salted joins and chunked folds."""

import collections
import gzip
import io
import zlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.operators import actions, joins, keyed, partitions
from millrace.sources import binary, files, vfs
from millrace.storage import Folder, scratch, written


def test_shared_map_versions_and_conflicts(spark, tmp_path):
    shared = actions.SharedMap(spark, "string", "int", str(tmp_path / "map"))
    assert shared.get("a") is None and shared.table().count() == 0
    first = shared.put({"a": 1, "b": 2})
    shared.put(spark.createDataFrame([("a", 5), ("a", 4), ("c", None)], "k string, v int"))
    assert (shared.get("a"), shared.get("b"), shared.get("c")) == ([4, 5], 2, None)
    shared.put({"b": None})
    assert rows(shared.table(first).select("k", F.col("v")[0])) == [("a", 1), ("b", 2)]
    assert shared.get("b") is None


def test_limits_of_what_is_sent(spark):
    with pytest.raises(actions.TooLarge):
        actions.shared_value(spark, bytes(1000), 100)
    with pytest.raises(actions.TooLarge):
        actions.reduce_to_driver(spark.range(20), "id", "id", "sum", 10)
    assert actions.reduce_to_driver(spark.range(6), F.col("id") % 2, "id", "sum") == {0: 6, 1: 9}


def test_accumulators_and_totals(spark):
    df = spark.range(0, 40, 1, 4)
    listed, table = actions.accumulator(spark, []), actions.accumulator(spark, {})
    actions.foreach_partition(df, lambda part: listed.add([sum(r["id"] for r in part)]))
    actions.foreach(df, lambda r: table.add({r["id"] % 3: True}))
    assert sum(listed.value) == sum(range(40)) and len(listed.value) == 4 and set(table.value) == {0, 1, 2}
    totals = actions.Totals(df, n=F.count("*"), s=F.sum("id"))
    assert totals.df.count() == 40
    assert totals.get() == {"n": 40, "s": 780}


def test_snapshot_is_written_once(spark, tmp_path):
    path = str(tmp_path / "kept")
    assert actions.snapshot(spark.range(3), path).count() == 3
    assert actions.snapshot(spark.range(9), path).count() == 3
    with actions.cached(spark.range(5)) as kept:
        assert kept.storageLevel.useMemory and kept.count() == 5
    assert not kept.storageLevel.useMemory


def test_fold_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(keyed, "CHUNK", 3)
    add = lambda a, v: a + v
    assert actions.fold(spark.range(11), "id", F.lit(0).cast("long"), add).first()[0] == 55
    assert actions.fold(spark.range(0), "id", F.lit(7).cast("long"), add).first()[0] == 7


@pytest.mark.parametrize("chunk", [1, 4, 4096])
def test_chunks_fold_like_whole_lists(spark, monkeypatch, chunk):
    monkeypatch.setattr(keyed, "CHUNK", chunk)
    data = spark.createDataFrame([(k, n, f"{k}{n}") for k in "ab" for n in range(10)] + [(None, 3, "x")], "k string, n int, v string")
    text = lambda a, v: F.concat(a, v)
    made = keyed.fold_by_key(data, "k", "v", F.lit(""), text, F.upper, "n", "s", combine=text)
    plain = keyed.fold_by_key(data, "k", "v", F.lit(""), text, F.upper, "n", "s")
    assert rows(made) == rows(plain)


def test_numbering_of_equal_rows_and_columns_that_clash(spark):
    data = spark.createDataFrame([(1, "a")] * 50 + [(0, "b"), (2, None)], "n int, s string")
    found = sorted(partitions.enumerate_rows(data, [F.col("n")], "at", 5).select("at", "n").collect())
    assert [r["at"] for r in found] == list(range(5, 57))
    assert [r["n"] for r in found] == [0] + [1] * 50 + [2]
    assert partitions.enumerate_rows(data.limit(0), [F.col("n")]).count() == 0
    plan = partitions.enumerate_rows(data, [F.col("n")])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


@pytest.mark.parametrize("kind", ["inner", "left"])
def test_skewed_join_equals_the_plain_one(spark, kind):
    left = spark.createDataFrame([(0, i) for i in range(300)] + [(k, k) for k in range(1, 40)] + [(None, 9)] * 30, "k int, a int")
    right = spark.createDataFrame([(0, "x"), (0, "y"), (5, "z"), (None, "n"), (99, "w")], "k int, b string")
    made = joins.skew_join(left, right, "k", kind, salts=4, share=0.1)
    assert collections.Counter(rows(made)) == collections.Counter(rows(left.join(right, "k", kind)))
    assert rows(joins.hot_keys(left, "k", 0.1)) == [(0,)]


def test_folder_and_written(spark):
    folder = Folder(spark, f"{scratch(spark)}/some").make()
    spark.range(3).write.parquet(f"{folder.path}/one")
    assert folder.names() == ["one"] and folder.has("one/_SUCCESS") and not folder.has("two")
    folder.drop("one")
    assert folder.names() == []
    assert written(spark.range(0)).count() == 0


# --- files of other schemes ---


@pytest.fixture()
def remote(tmp_path):
    from pyarrow import fs

    system = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    vfs.register("box", lambda uri: (system, uri.partition("://")[2]))
    yield "box://"
    del vfs.SCHEMES["box"]


def test_files_of_a_registered_scheme(remote):
    vfs.makedirs(f"{remote}a/b")
    for name in ("a/x.txt", "a/b/y.txt", "a/.hidden", "a/_done", "a/z.bin"):
        with vfs.open(f"{remote}{name}", "wb") as f:
            f.write(b"one\ntwo\nthree")
    assert files.expand(f"{remote}a", ".txt") == [f"{remote}a/b/y.txt", f"{remote}a/x.txt"]
    assert files.expand(f"{remote}a", max_depth=0) == [f"{remote}a/x.txt", f"{remote}a/z.bin"]
    assert vfs.glob(f"{remote}a/*.txt") == [f"{remote}a/x.txt"]
    assert (vfs.getsize(f"{remote}a/x.txt"), vfs.stat(f"{remote}a/x.txt").size) == (13, 13)
    with vfs.open(f"{remote}a/x.txt") as f:
        f.seek(4)
        assert (f.readline(), f.tell(), f.read()) == (b"two\n", 8, b"three")
    vfs.replace(f"{remote}a/x.txt", f"{remote}a/w.txt")
    assert not vfs.exists(f"{remote}a/x.txt") and vfs.isfile(f"{remote}a/w.txt") and vfs.isdir(f"{remote}a/b")
    vfs.remove(f"{remote}a/w.txt")
    vfs.rmtree(f"{remote}a/b")
    assert files.expand(f"{remote}a") == [f"{remote}a/z.bin"]
    with pytest.raises(FileNotFoundError):
        vfs.stat(f"{remote}nothing")


def test_records_of_a_registered_scheme(remote):
    """Readers see the same lines and records in every split."""
    with vfs.open(f"{remote}lines.txt", "wb") as f:
        f.write("".join(f"line {i}\n" for i in range(100)).encode())
    for split in (7, 64, 1 << 20):
        reader = binary.ByteRangeReader({"path": f"{remote}lines.txt", "split": str(split)})
        assert [line for p in reader.partitions() for (line,) in reader.read(p)] == [f"line {i}" for i in range(100)]
    with vfs.open(f"{remote}some.tfrecords", "wb") as f:
        writer = binary.TFRecordWriter.__new__(binary.TFRecordWriter)
        for i in range(50):
            f.write(writer.encode((f"record {i}",)))
    for split in (30, 1 << 20):
        reader = binary.TFRecordReader({"path": f"{remote}some.tfrecords", "split": str(split)})
        assert [v for p in reader.partitions() for (v,) in reader.read(p)] == [f"record {i}" for i in range(50)]


@pytest.mark.parametrize("split", [1, 7, 50, 200, 1 << 20])
@pytest.mark.parametrize("piece", [5, 33, 1000])
def test_gzip_members_in_every_split(tmp_path, piece, split):
    """Lines across members, members without a line end, and a last line without one."""
    lines = [f"line {i} " + "x" * (i % 17) for i in range(60)] + ["y" * 90, "", "last"]
    data = "\n".join(lines).encode()
    (tmp_path / "a.gz").write_bytes(b"".join(gzip.compress(data[i : i + piece]) for i in range(0, len(data), piece)))
    reader = binary.GzipBlocksReader({"path": str(tmp_path), "split": str(split)})
    assert [v for p in reader.partitions() for (v,) in reader.read(p)] == lines


def test_damaged_gzip_members(tmp_path):
    members = [gzip.compress(f"{i}\n".encode() * 50) for i in range(4)]
    members[1] = members[1][:12] + b"\xff\xff\xff" + members[1][15:]
    (tmp_path / "a.gz").write_bytes(b"".join(members))

    def found(**options):
        reader = binary.GzipBlocksReader({"path": str(tmp_path), **options})
        return {v for p in reader.partitions() for (v,) in reader.read(p)}

    assert found(skip_damaged="true") == {"0", "2", "3"}
    with pytest.raises(zlib.error):
        found()


@pytest.mark.parametrize("n", [0, 1, 9, 255, 256, 257, 1000])
def test_checksums_by_blocks(n):
    def plain(data):
        crc = 0xFFFFFFFF
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    data = bytes((i * 37 + n) % 256 for i in range(n))
    assert binary.crc32c(data) == plain(data)
    assert binary.crc32c(b"123456789") == 0xE3069283


def test_plain_paths_are_local(tmp_path):
    path = f"file://{tmp_path}/f"
    with vfs.open(path, "wb") as f:
        f.write(b"x")
    assert vfs.exists(path) and vfs.local(path) == f"{tmp_path}/f" and vfs.local("s3://b/k") == "s3://b/k"
    assert isinstance(vfs.open(path), io.BufferedReader)
