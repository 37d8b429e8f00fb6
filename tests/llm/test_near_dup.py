"""Near-duplicates at the threshold itself: none may be lost."""

import numpy as np

from millrace.llm import near_dup


def test_pairs_at_the_threshold_are_all_found(spark):
    # 90 shingles, of which the last ten differ: 80 of 100 are shared. No third text links a pair.
    rows = []
    for k in range(1500):
        words = [f"w{k}x{i}" for i in range(94)]
        other = [*words[:84], *(f"v{k}x{i}" for i in range(10))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    sets = [set(near_dup.shingle_hashes(t).tolist()) for _, t in rows[:2]]
    assert len(sets[0] & sets[1]) == 0.8 * len(sets[0] | sets[1])
    made = near_dup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in made.collect()} == {2 * k for k in range(1500)}


def linked(ids, sets):
    odd = near_dup.multipliers()
    signs = np.array([(near_dup.signature(s, odd) >> np.uint64(32)).astype("<u4") for s in sets])
    low = [s.astype("<u8").tobytes() for s in sets]
    root = {i: i for i in ids}
    for a, b in near_dup.group_forest(ids, signs, low, 0.8):
        root = {i: root[a] if r == root[b] else r for i, r in root.items()}
    return root, signs


def test_a_text_near_to_one_behind_an_all_but_equal_one():
    seen = 0
    for seed in range(40):
        x = np.random.default_rng(seed).integers(0, 1 << 63, 400, dtype=np.uint64)
        new = np.random.default_rng(1000 + seed).integers(0, 1 << 63, 60, dtype=np.uint64)
        # The first shares 392 of 408 with x and 348 of 452 with z; x and z share 356 of 444.
        first, z = np.concatenate([x[8:], new[:8]]), np.concatenate([x[:356], new[8:52]])
        root, signs = linked([0, 1, 2], [first, x, z])
        seen += (signs[0] == signs[1]).mean() >= 0.95
        assert root[0] == root[1] == root[2]
    assert seen > 0


def test_groups_against_brute_force(monkeypatch):
    for many in (1, 16):
        monkeypatch.setattr(near_dup, "MANY", many)
        rng = np.random.default_rng(many)
        base = rng.integers(0, 1 << 63, (4, 120), dtype=np.uint64)
        sets = [np.concatenate([base[k % 4][: 120 - m], rng.integers(0, 1 << 63, m, dtype=np.uint64)]) for k, m in enumerate(rng.integers(0, 24, 80).tolist())]
        root, _ = linked(list(range(80)), sets)
        plain = [set(s.tolist()) for s in sets]
        for a in range(80):
            for b in range(a):
                if len(plain[a] & plain[b]) >= 0.8 * len(plain[a] | plain[b]):
                    assert root[a] == root[b]
