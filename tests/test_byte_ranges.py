"""Small splits of large files do not make a task of every few records."""

import pytest

from millrace.sources import binary


@pytest.mark.parametrize("size", [10_000_000, 100_000_000])
@pytest.mark.parametrize("split,unit", [(4096, 12), (8192, 1), (65536, 256)])
def test_ranges_do_not_grow_with_the_file(monkeypatch, size, split, unit):
    monkeypatch.setattr(binary.vfs, "getsize", lambda path: size)
    ranges = binary.byte_ranges(["a", "b"], split, unit)
    assert len(ranges) <= binary.MOST_RANGES + 2
    assert all(r.begin % unit == 0 for r in ranges)
    for path in "ab":
        mine = [r for r in ranges if r.path == path]
        assert [r.begin for r in mine] == [0, *(r.end for r in mine[:-1])] and mine[-1].end == size


def test_large_splits_stay(monkeypatch):
    monkeypatch.setattr(binary.vfs, "getsize", lambda path: 1000 * binary.SPLIT)
    assert len(binary.byte_ranges(["a"], binary.SPLIT)) == 1000
    assert len(binary.byte_ranges(["a"], 8192)) == 1000


def test_readers_take_all_records(spark, tmp_path):
    n = 30_000
    lines = spark.range(0, n, 1, 2).selectExpr("CONCAT('line ', id) AS value")
    binary.write_limited(lines, "tfrecord", str(tmp_path / "records"))
    read = spark.read.format("tfrecord").option("split", 512).load(str(tmp_path / "records"))
    assert read.rdd.getNumPartitions() <= binary.MOST_RANGES + 2
    assert read.distinct().count() == read.count() == n
    (tmp_path / "lines.txt").write_text("".join(f"line {i}\n" for i in range(n)))
    text = spark.read.format("byterange").options(path=str(tmp_path / "lines.txt"), split=512).load()
    assert text.rdd.getNumPartitions() <= binary.MOST_RANGES + 2
    assert text.distinct().count() == text.count() == n
