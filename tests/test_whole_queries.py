"""Queries over all rows and edges, on small fixtures with unmatched keys, gaps and parted graphs."""

import datetime

import pytest
from conftest import rows

from millrace.queries import catalogue

QUERIES = catalogue.queries()


def written(spark, tmp_path, name, data, schema):
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.fixture()
def graph(spark, tmp_path):
    # Orders give the edges 1-7, 7-20, 20-14 and, apart from them, 30-31; 7 and 14 send as any other.
    lines = [(k, n, s) for k, (a, b) in enumerate([(1, 7), (7, 20), (20, 14), (30, 31)]) for n, s in ((1, a), (2, b))]
    return written(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_linenumber int, l_suppkey long")


def test_paths_over_all_edges(spark, graph):
    assert dict(map(tuple, QUERIES["sssp"](spark, graph).collect())) == {1: 0, 7: 1, 20: 2, 14: 3, 30: None, 31: None}


def test_components_over_all_edges(spark, graph):
    assert rows(QUERIES["components"](spark, graph)) == [(1, 1), (7, 1), (14, 1), (20, 1), (30, 30), (31, 30)]


def test_page_ranks_take_all_edges(spark, graph, monkeypatch):
    from millrace.graph import pregel

    seen, plain = [], pregel.pagerank
    monkeypatch.setattr(pregel, "pagerank", lambda edges, **more: seen.append(rows(edges)) or plain(edges, **more))
    assert len(rows(QUERIES["pagerank"](spark, graph))) == 6
    assert seen == [[(1, 7), (7, 20), (20, 14), (30, 31)]]


def test_empty_windows(spark, tmp_path):
    hours = [0, 0, 1, 4]
    events = [(i, datetime.datetime(2024, 1, 1, h, 5), 1, "click", 1.0, "") for i, h in enumerate(hours)]
    folder = written(spark, tmp_path, "events", events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    found = QUERIES["stream_count_zero_fill"](spark, folder).orderBy("w").collect()
    assert [(r["w"].hour, r["n"]) for r in found] == [(0, 2), (1, 1), (2, 0), (3, 0), (4, 1)]


def test_unmatched_keys(spark, tmp_path):
    written(spark, tmp_path, "customer", [(3, "a"), (4, "b")], "c_custkey long, c_name string")
    folder = written(spark, tmp_path, "orders", [(1, 3), (2, 5), (3, 3)], "o_orderkey long, o_custkey long")
    both = [(3, 1), (3, 3)]
    for kind, more in {"inner": [], "left": [(4, None)], "right": [(None, 2)], "full": [(4, None), (None, 2)]}.items():
        assert rows(QUERIES[f"join_{kind}"](spark, folder)) == both + more, kind
