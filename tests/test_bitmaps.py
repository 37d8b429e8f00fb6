"""Bitmaps of many small groups, united."""

from conftest import rows
from pyspark.sql import functions as F

from millrace.operators import sketches


def test_bitmaps_are_not_sorted_or_shuffled(spark):
    data = [(k, u, p) for k in "ab" for u in range(5) for p in (u, u, 40_000 * u, 32_768 + u)] + [("a", 9, None)]
    df = spark.createDataFrame(data, "k string, u long, p long")
    made = sketches.bitmap(df, ["k", "u"], "p")
    assert made.columns == ["k", "u", "bucket", "bits"]
    n = made.select("k", "u", "bucket", F.bitmap_count("bits").alias("n"), F.length("bits").alias("l"))
    assert all(r["l"] == 4096 for r in n.collect())
    assert made.agg(F.sum(F.bitmap_count("bits"))).first()[0] == sum(len({p for a, u, p in data if (a, u) == g} - {None}) for g in {(a, u) for a, u, _ in data})
    united = sketches.bitmap_union(made.select("k", "bucket", "bits"), ["k"])
    counts = united.groupBy("k").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert rows(counts) == [(k, len({p for a, _, p in data if a == k} - {None})) for k in "ab"]
    # The one sort is that of positions; above it only counts are shuffled.
    assert plan.count("Sort [") == 1 and plan.index("__bit") < plan.index("Sort [")
    assert plan.count("Exchange ") == 3
