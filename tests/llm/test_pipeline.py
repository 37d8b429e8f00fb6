"""The pipeline, stage by stage, against plain versions of what each stage decides."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import near_dup, pii

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and returned."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SMALL).write.parquet(path)
        made = spark.read.parquet(path)
        out.append((docs, made))
        docs = made
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "PII", "best-fit packing"]
    for before, after in stages[:-1]:
        assert before.columns == after.columns


def test_quality_rejects_what_is_labelled_bad(stages):
    before, after = (texts(x) for x in stages[0])
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SMALL}/labels.parquet'").fetchall())
    assert set(after) < set(before)
    assert all(after[i] == before[i] for i in after)
    right = [(i in after) == bool(q) for i, q in label.items() if i in before]
    assert np.mean(right) > 0.93


def test_lines(stages):
    from test_dedup_operators import lines_by_hand

    before, after = (texts(x) for x in stages[1])
    assert after == dict(lines_by_hand(list(before.items())))


def test_one_of_each_group_stays(stages):
    before, after = (texts(x) for x in stages[2])
    sets = {i: set(near_dup.shingle_hashes(t).tolist()) for i, t in before.items()}
    ids = sorted(before)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(after) == {i for i in ids if find(i) == i}
    assert all(after[i] == before[i] for i in after)


def test_masking(stages):
    before, after = (texts(x) for x in stages[3])
    assert after == {i: pii.masked(t) for i, t in before.items()}
    assert not any(pii.base_spans(t or "") for t in after.values() if t and "@" in t)


def test_packing(stages):
    before, pieces = stages[4][0], stages[4][1].toPandas()
    assert set(pieces.doc_id) == set(texts(before))
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048
    assert pieces.sequence_id.nunique() <= -(-pieces.length.sum() // 2048) + 1


def test_run(spark, stages):
    """The same pieces of the same documents; only the sequences' numbers may differ."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    made = corpus_pipeline.run(spark, SMALL).toPandas()
    again = stages[4][1].toPandas()
    assert sorted(map(tuple, made[columns].values.tolist())) == sorted(map(tuple, again[columns].values.tolist()))
    assert made.groupby("sequence_id").length.sum().max() <= 2048
    for _, rows in made.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]]


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, __uid string"
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "s", 0, 1.0, "x"), (1, "", "en", "s", 0, 1.0, "x"), (2, "plain words here to be kept as they are.", "en", "s", 0, 1.0, "x")]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, SMALL)
            assert made.columns == docs.columns, name
            assert made.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
