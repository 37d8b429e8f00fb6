"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum, looked up by node; the edge table is written after each round (so
lineage stays short and executors may go), and rounds are logarithmic in a component's length, so
they end by themselves. Before the first round each task replaces its own edges by stars, which
shortens long paths. A node with very many edges is no hot key: minima are taken after partial
aggregation, and they are sent to the edges while their table is small enough; beyond that the
join is shuffled, with skewed partitions split by adaptive execution. Nothing is gathered on the
driver but three numbers a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small_or_shuffled, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the same components in which each node points at its component's least node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        if (root == before).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def local_stars(batches):
    """One task's edges as stars, a bounded number of edges at a time."""
    for batch in batches:
        if batch.num_rows:
            a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def minima(pairs: DataFrame, value) -> DataFrame:
    """a, m: written, and marked for broadcast if it is small."""
    least = written(pairs.groupBy("a").agg(value.alias("m")))
    return small_or_shuffled(least, least.count(), 16)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (a, b: long) that
    is not a root itself. Null ends, self-loops and repeated edges are harmless."""
    clean = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    now = written(clean.mapInArrow(local_stars, "a long, b long").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if not mark["n"] or (mark["n"], mark["s"]) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = (mark["n"], mark["s"])
        # Large star: each node's larger neighbours point at the least of its neighbourhood.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = minima(both, F.least(F.min("b"), F.first("a")))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        large = written(large.distinct())
        # Small star: each node and its smaller neighbours point at the least of them.
        lower = minima(large, F.min("b"))
        small = large.join(lower, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct())
