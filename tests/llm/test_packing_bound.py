"""Blocks go on to their lower bound, also when there are several."""

import numpy as np

from millrace.llm import packing


def test_several_blocks_may_not_rest_above_their_bound(spark, monkeypatch):
    sizes = np.random.default_rng(1).integers(200, 1400, 3200).tolist()
    pieces = spark.createDataFrame(list(enumerate(sizes)), "uid long, length int")
    given, plain = [], packing.pack_blocks

    def spied(items, blocks, capacity, islands, epochs, seed, *more):
        given.append((blocks, more))
        return plain(items, blocks, capacity, islands, epochs, seed, *more)

    monkeypatch.setattr(packing, "pack_blocks", spied)
    made = packing.pack(pieces, 2048, islands=1, epochs=1).toPandas()
    assert given[0][0] > 1 and not any(any(more) for _, more in given)
    assert sorted(made.uid) == list(range(3200))
    assert made.groupby("sequence_id").length.sum().max() <= 2048
