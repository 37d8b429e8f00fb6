"""Graph programs go on until nothing is under way, or say that they did not."""

import pytest

from millrace.graph import pregel

LENGTH = 104


@pytest.fixture()
def chain(spark):
    return spark.createDataFrame([(i, i + 1) for i in range(LENGTH)], "src long, dst long").coalesce(1)


@pytest.mark.parametrize("program", [lambda e, n: pregel.shortest_paths(e, 0, max_supersteps=n), lambda e, n: pregel.connected_components(e, n)])
def test_a_given_limit_that_is_too_low_is_an_error(chain, program):
    with pytest.raises(RuntimeError, match="3 supersteps"):
        program(chain, 3)


def test_a_limit_that_is_just_enough(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    assert dict(map(tuple, pregel.shortest_paths(edges, 0, max_supersteps=3).collect())) == {0: 0, 1: 1, 2: 2}


def test_distances_along_a_long_chain(chain):
    assert dict(map(tuple, pregel.shortest_paths(chain, 0).collect())) == {i: i for i in range(LENGTH + 1)}
