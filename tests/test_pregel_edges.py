"""Graph programs compute their edges once, however many steps they take."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.graph import pregel

PAIRS = [(i, (i * 7 + j) % 20) for i in range(20) for j in (1, 3) if i != (i * 7 + j) % 20]


def counted(spark):
    """Edges that count how often one of them is computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def same(x):
        seen.add(1)
        return x

    return spark.createDataFrame(PAIRS, "src long, dst long").coalesce(1).select(same.asNondeterministic()("src").alias("src"), "dst"), seen


@pytest.mark.parametrize("program", [pregel.pagerank, pregel.connected_components, lambda e: pregel.shortest_paths(e, 0)])
def test_edges_are_computed_once(spark, program):
    edges, seen = counted(spark)
    rows(program(edges))
    # Ranges are chosen from a sample, so edges without a shuffle before them are read twice.
    assert seen.value <= 2 * 2 * len(PAIRS)


def ranks(n_steps):
    ids = sorted({x for p in PAIRS for x in p})
    out = {i: [b for a, b in PAIRS if a == i] for i in ids}
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(n_steps):
        new = dict.fromkeys(ids, 0.15 / len(ids))
        for i in ids:
            for b in out[i]:
                new[b] += 0.85 * rank[i] / len(out[i])
        rank = new
    return rank


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_ranks_with_vertices_sent_or_shuffled(spark, monkeypatch, limit):
    monkeypatch.setattr(pregel, "SENT_BYTES", limit)
    edges = spark.createDataFrame(PAIRS, "src long, dst long")
    found = dict(map(tuple, pregel.pagerank(edges, epsilon=0.0, most_steps=12).collect()))
    assert found == pytest.approx(ranks(12))
