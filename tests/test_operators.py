"""Literal goldens of the operators."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.graph import examples, pregel
from millrace.operators import joins, keyed, partitions, sketches


@pytest.fixture(scope="module")
def kv(spark):
    return spark.createDataFrame([(1, 4), (2, 5), (3, 6), (3, 7)], "k long, v long").repartition(2)


def test_reduce_and_group_by_key(kv):
    assert rows(keyed.reduce_by_key(kv, "k", "v", "sum")) == [(1, 4), (2, 5), (3, 13)]
    assert rows(keyed.group_by_key(kv, "k", "v", order="v")) == [(1, [4]), (2, [5]), (3, [6, 7])]
    assert rows(keyed.reduce_by_key(kv, "k", "v", F.max)) == [(1, 4), (2, 5), (3, 7)]
    assert keyed.lookup(kv, "k", 2, "v") == 5
    assert keyed.lookup(kv, "k", 4, "v") is None


def test_fold_is_ordered(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "k string, o int, v string")
    made = keyed.fold_by_key(df, "k", "v", F.lit(""), lambda a, v: F.concat(a, v), order="o")
    assert rows(made) == [("a", "xy"), ("b", "z")]


@pytest.mark.parametrize(
    ("kind", "expected"),
    [
        ("inner", [(2, 5, 1), (3, 6, 2), (3, 7, 2)]),
        ("left", [(1, 4, None), (2, 5, 1), (3, 6, 2), (3, 7, 2)]),
        ("right", [(2, 5, 1), (3, 6, 2), (3, 7, 2), (4, None, 3)]),
        ("full", [(1, 4, None), (2, 5, 1), (3, 6, 2), (3, 7, 2), (4, None, 3)]),
    ],
)
@pytest.mark.parametrize("null_safe", [False, True])
def test_joins(spark, kv, kind, expected, null_safe):
    right = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "k long, w long")
    assert sorted(map(tuple, joins.join(kv, right, "k", kind, null_safe).collect()), key=str) == sorted(expected, key=str)


def test_null_keys(spark):
    a = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int")
    b = spark.createDataFrame([(None, 3), (2, 4)], "k int, w int")
    assert joins.join(a, b, "k").count() == 0
    assert rows(joins.join(a, b, "k", null_safe=True)) == [(None, 1, 3)]
    assert sorted(map(tuple, joins.join(a, b, "k", "full", null_safe=True).collect()), key=str) == sorted([(None, 1, 3), (1, 2, None), (2, None, 4)], key=str)


def test_repeated_keys_and_broadcast(spark, kv):
    right = spark.createDataFrame([(2, 1), (2, 2), (4, 3)], "k long, w long")
    expected = [(2, 5, 1), (2, 5, 2)]
    assert rows(joins.join(kv, right, "k")) == expected
    assert rows(joins.broadcast_join(kv, right, "k")) == expected
    assert rows(joins.broadcast_join(kv, right, "k", limit_bytes=0)) == expected
    assert rows(joins.skew_join(kv, right, "k")) == expected


def test_left_join_last(spark, kv):
    right = spark.createDataFrame([(2, 1, "a"), (2, 2, "b")], "k long, seq int, w string")
    assert rows(joins.left_join_last(kv, right, "k", "seq").select("k", "v", "w")) == [(1, 4, None), (2, 5, "b"), (3, 6, None), (3, 7, None)]


def test_cogroup(spark):
    a = spark.createDataFrame([(1, 1), (2, None)], "k int, v int")
    b = spark.createDataFrame([(2, 3), (None, 4)], "k int, v int")
    c = spark.createDataFrame([(2, 5)], "k int, v int")
    made = joins.cogroup([a, b, c], "k", "v")
    assert sorted(map(tuple, made.collect()), key=str) == sorted([(1, [1], [], []), (2, [None], [3], [5]), (None, [], [4], [])], key=str)


def test_cartesian_and_union(spark):
    a = spark.range(4).select(F.col("id").alias("x"))
    assert joins.cartesian(a, a.select(F.col("x").alias("y"))).agg(F.sum(F.col("x") * F.col("y"))).first()[0] == 36
    assert joins.union([a, a]).count() == 8
    with pytest.raises(ValueError):
        joins.union([])


def test_upsert(spark):
    old = spark.createDataFrame([("foo", 1), ("wtf", 233)], "k string, v long")
    new = spark.createDataFrame([("foo", 2), ("bar", 3), ("wtf", None)], "k string, v long")
    assert rows(keyed.upsert(old, new, "k", "v")) == [("bar", 3), ("foo", 2), ("wtf", None)]
    assert rows(keyed.upsert(old, new, "k", "v", replace_only=True)) == [("foo", 2), ("wtf", None)]


def test_top_by_key(spark):
    data, v = [], 5
    for k in range(1, 7):
        for _ in range(k):
            data.append((k, v))
            v += 1
    df = spark.createDataFrame(data, "k int, v int").repartition(3)
    small = dict(map(tuple, keyed.top_lists_by_key(df, "k", "v", 2, ties="v").collect()))
    assert small[3] == [8, 9]
    large = dict(map(tuple, keyed.top_lists_by_key(df, "k", "v", 3, reverse=True, ties="v").collect()))
    assert large[4] == [14, 13, 12]


def test_top_by_key_keeps_the_earliest_of_ties(spark):
    df = spark.createDataFrame([(1, 5, i) for i in range(6)], "k int, o int, id int").repartition(3)
    assert sorted(r["id"] for r in keyed.top_by_key(df, "k", "o", 2, ties="id").collect()) == [0, 1]
    assert sorted(r["id"] for r in keyed.top_by_key(df, "k", "o", 2, reverse=True, ties="id").collect()) == [0, 1]


def test_hot_and_uniq(spark):
    values = list(range(100)) + [i for i in range(10) for _ in range(i + 1)]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "x int").repartition(10)
    assert [tuple(r) for r in keyed.hot(df, "x").collect()] == [(i, i + 2) for i in range(9, -1, -1)]
    assert keyed.uniq(df).count() == 100
    assert dict(map(tuple, keyed.hot_approx(df, "x", 3).collect()))[9] == 11


def test_salted_aggregate(spark):
    df = spark.createDataFrame([("hot", i) for i in range(200)] + [("cold", 1)], "k string, v int")
    made = keyed.salted_aggregate(df, ["k"], {"s": F.sum("v"), "n": F.count("*")}, {"s": F.sum("s"), "n": F.sum("n")})
    assert rows(made) == [("cold", 1, 1), ("hot", 19900, 200)]


def test_enumerate(spark):
    df = spark.range(100).repartition(10).select(F.col("id").alias("x"))
    assert rows(partitions.enumerate_rows(df, [F.col("x")])) == [(i, i) for i in range(100)]
    assert rows(partitions.enumerate_rows(df, [F.col("x").desc()], "rk", 1)) == [(i, 100 - i) for i in range(100)]
    assert partitions.enumerate_rows(df.filter("x < 0"), [F.col("x")]).count() == 0


def test_batches(spark):
    df = spark.range(1234).select(F.col("id").alias("x"))
    sizes = [len(r["rows"]) for r in partitions.batch(df, 100, [F.col("x")]).collect()]
    assert sorted(sizes, reverse=True) == [100] * 12 + [34]
    sizes = [len(r[0]) for r in partitions.batch_within_partitions(df.repartition(10), 100).collect()]
    assert sum(sizes) == 1234
    assert max(sizes) == 100


def test_partitions(spark):
    df = spark.range(0, 4, 1, 2).select(F.col("id").alias("x"))
    assert [[r["x"] for r in row["rows"]] for row in partitions.glom(df).orderBy("partition").collect()] == [[0, 1], [2, 3]]
    assert rows(partitions.slice_partitions(df, 0, 1)) == [(0,), (1,)]
    assert partitions.merge_split(df, n=1).rdd.getNumPartitions() == 1
    assert partitions.merge_split(spark.range(0, 8, 1, 8), size=3).rdd.getNumPartitions() == 3
    assert rows(partitions.enumerate_partition(df)) == [(0, 0), (1, 0), (2, 1), (3, 1)]
    assert rows(partitions.pipe(df, "x", "cat")) == [("0",), ("1",), ("2",), ("3",)]
    assert partitions.sample(df, 1.0).count() == 4
    with pytest.raises(ValueError):
        partitions.merge_split(df)


def test_zip(spark):
    a = spark.createDataFrame([(i,) for i in range(5)], "l int")
    b = spark.createDataFrame([(c,) for c in "abc"], "r string")
    assert rows(joins.zip_with(a, b, [F.col("l")], [F.col("r")])) == [(0, "a"), (1, "b"), (2, "c")]


def test_tolerant_map(spark):
    df = spark.range(100).select(F.col("id").alias("x"))
    fine = partitions.tolerant_map(df, "r", F.try_divide(F.lit(1.0), F.col("x")), 0.02)
    assert fine.df.count() == 99
    assert fine.check() == {"total": 100, "failed": 1}
    bad = partitions.tolerant_map(df, "r", F.try_divide(F.lit(1.0), F.col("x")), 0.001)
    bad.df.count()
    with pytest.raises(partitions.TooManyErrors):
        bad.check()


def test_percentiles(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(k, rng.gauss(k, 1)) for k in range(3) for _ in range(3000)], "k int, x double")
    for key, found in map(tuple, sketches.percentiles_by_key(df, "k", "x", [10, 50, 90]).collect()):
        assert all(abs(a - b) < 0.2 for a, b in zip(found, (key - 1.2816, key, key + 1.2816)))
    exact = sketches.percentiles(df.filter("k = 0"), "x", [50], exact=True).first()[0][0]
    assert abs(exact) < 0.1
    with pytest.raises(ValueError):
        sketches.percentiles(df, "x", [101])


def test_distinct_sketches_merge(spark):
    df = spark.range(2000).select(F.col("id").alias("x"), (F.col("id") % 2).alias("half"))
    stored = sketches.distinct_sketch(df, ["half"], "x")
    n = sketches.merge_distinct(stored.withColumn("all", F.lit(1)), ["all"]).first()["n"]
    assert abs(n - 2000) < 60
    assert sketches.adcount(df, "x").first()["n"] == pytest.approx(2000, rel=0.05)


def test_positions_and_bloom(spark):
    a, b = spark.range(0, 6).toDF("pos"), spark.range(4, 9).toDF("pos")
    assert [r[0] for r in rows(sketches.positions(a, "intersect", b))] == [4, 5]
    assert [r[0] for r in rows(sketches.positions(a, "except", b))] == [0, 1, 2, 3]
    assert [r[0] for r in rows(sketches.positions(a, "xor", b))] == [0, 1, 2, 3, 6, 7, 8]
    assert sketches.positions(a, "union", b).count() == 9
    bits, hashes = sketches.bloom_parameters(1000, 0.01)
    assert (bits, hashes) == (9586, 7)


EDGES = [("0", "1", 2), ("0", "2", 5), ("1", "2", 1), ("2", "3", 4), ("4", "5", 1)]


def test_graphs(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string, w int")
    found = dict(map(tuple, pregel.shortest_paths(edges, "0", "w").collect()))
    assert found == {"0": 0.0, "1": 2.0, "2": 3.0, "3": 7.0, "4": None, "5": None}
    assert dict(map(tuple, pregel.connected_components(edges).collect())) == {"0": "0", "1": "0", "2": "0", "3": "0", "4": "4", "5": "4"}


def test_pagerank(spark):
    links = {"a": "bc", "b": "c", "c": "a", "d": "c"}
    edges = spark.createDataFrame([(s, d) for s, out in links.items() for d in out], "src string, dst string")
    found = dict(map(tuple, pregel.pagerank(edges, epsilon=1e-9).collect()))
    rank = dict.fromkeys(links, 0.25)
    for _ in range(60):
        rank = {v: 0.15 / 4 + 0.85 * sum(rank[s] / len(out) for s, out in links.items() if v in out) for v in links}
    assert all(abs(found[v] - rank[v]) < 1e-2 for v in links)


def test_examples(spark):
    points = spark.createDataFrame([(i, [float(i % 2 * 10 + i % 3 * 0.1), 0.0]) for i in range(30)], "id long, x array<double>")
    assert sorted(r["n"] for r in examples.kmeans(points, 2).collect()) == [15, 15]
    labelled = spark.createDataFrame([([1.0, float(v)], 1.0 if v > 0 else -1.0) for v in (-3, -2, 2, 3)], "x array<double>, y double")
    assert examples.logistic_regression(labelled, 50).first()["w"][1] > 0.3
    ratings = spark.createDataFrame([("a", "u", 1.0), ("b", "u", 1.0), ("a", "v", 2.0), ("c", "v", None)], "item string, user string, rating double")
    assert rows(examples.item_similarity(ratings))[0][:2] == ("a", "b")
    assert abs(examples.estimate_pi(spark).first()[0] - 3.14) < 0.1
