"""The near-duplicate stage finds its pairs by SimHash fingerprints."""

import numpy as np

import corpus_pipeline
from millrace.llm import near_dup, simhash


def plain_bits(hashes, odd):
    """The fingerprint's bits counted one by one."""
    wrap, out = (1 << 64) - 1, []
    for m in odd.tolist():
        words = []
        for h in hashes.tolist():
            x = (h ^ h >> 29) * m & wrap
            x ^= x >> 32
            x = x * 0x9E3779B97F4A7C15 & wrap
            words.append(x ^ x >> 29)
        out.append(sum(1 << b for b in range(64) if 2 * sum(w >> b & 1 for w in words) > len(words)))
    return out


def test_fingerprints_are_majorities():
    for n in (1, 2, 5, 40, 41, 600):
        hashes = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
        made = near_dup.fingerprint(hashes, near_dup.multipliers(), near_dup.multipliers(near_dup.LONGER))
        assert len(made) == (near_dup.LONGER if n <= near_dup.SHORT else near_dup.LENGTH)
        few = near_dup.multipliers()[:3]
        assert made[:3].tolist() == plain_bits(hashes, few)


def test_forest_of_a_key_against_all_pairs():
    rng = np.random.default_rng(5)
    group = np.sort(rng.integers(0, 30, 400))
    own, after = (rng.integers(0, 4, (2, 400)).astype(np.uint64) * np.uint64(0x0123456789ABCDEF))
    node = np.arange(400)
    a, b = near_dup.near_rows(group, node, own, after)
    root = dict(zip(a.tolist(), b.tolist()))
    want = list(range(400))
    for x in range(400):
        for y in range(x):
            if group[x] == group[y] and sum(int(w[x] ^ w[y]).bit_count() for w in (own, after)) <= near_dup.FAR:
                high, low = max(want[x], want[y]), min(want[x], want[y])
                want = [low if r == high else r for r in want]
    assert [root.get(x, x) for x in range(400)] == want


def words_of(k, n, changed):
    """Two texts of n words whose last ``changed`` words differ."""
    first = [f"w{k}x{i}" for i in range(n)]
    return " ".join(first), " ".join([*first[: n - changed], *(f"v{k}x{i}" for i in range(changed))])


def test_stage_uses_fingerprints_and_golay_keys(spark, monkeypatch):
    seen = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, *more: seen.append(nodes.count()) or links(nodes, *more))
    rows = [(2 * k + i, t) for k in range(4) for i, t in enumerate(words_of(k, 94, 10))]
    made = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in made.collect()} == {0, 2, 4, 6}
    assert seen == [8]


def test_short_texts_at_the_threshold_and_crowded_keys(spark, monkeypatch):
    # Nine words have five shingles, of which the first eight words share four.
    rows = []
    for k in range(300):
        words = [f"w{k}x{i}" for i in range(9)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:8]))]
    # Every key that the sample sees is dealt into parts.
    monkeypatch.setattr(near_dup, "KEY_GROUP", 5)
    made = near_dup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in made.collect()} == {2 * k for k in range(300)}
