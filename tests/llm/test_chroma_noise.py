"""Alignment of recordings with bit errors, against all pairs and all offsets."""

import numpy as np
import pytest

from millrace.llm import chroma


def brute(own, other):
    """Least bit error over the offsets that cover enough codes."""
    least = min(chroma.MIN_OVERLAP, len(own), len(other))
    offsets = [o for o in range(1 - len(other), len(own)) if min(len(other), len(own) - o) - max(0, -o) >= least]
    return min((chroma.bit_error(own, other, o), o) for o in offsets)


def noisy(codes, share, rng):
    wrong = rng.random((len(codes), 32)) < share
    return codes ^ (wrong << np.arange(32)).sum(1).astype(np.uint32)


@pytest.mark.parametrize("share", [0.1, 0.15, 0.2])
def test_noisy_recordings_against_all_pairs_and_offsets(share):
    rng = np.random.default_rng(int(share * 100))
    prints = [chroma.fingerprint(chroma.sonified(rng.normal(size=64).tolist())) for _ in range(60)]
    queries = [noisy(p, share, rng)[k % 20 :] for k, p in enumerate(prints)]
    state = chroma.Align([1000 + k for k in range(60)], [q.astype("<u4").tobytes() for q in queries])
    state.add(list(range(60)), [p.astype("<u4").tobytes() for p in prints])
    for k, q in enumerate(queries):
        (error, offset), match = min((brute(p, q), j) for j, p in enumerate(prints))
        assert match == k and offset == k % 20
        assert state.best[k][1:3] == (match, offset)
        assert state.best[k][0] == pytest.approx(error)


def test_unlike_recordings_of_any_length_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    prints = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (70, 1, 20, 150, 20, 64)] + [np.zeros(70, np.uint32), np.zeros(90, np.uint32)]
    for most in (1024, 1 << 22):
        monkeypatch.setattr(chroma, "AT_ONCE", most)
        data = [p.astype("<u4").tobytes() for p in prints]
        state = chroma.Align(list(range(8)), data)
        state.add([0, 1, 2], data[:3])
        state.add([3, 4, 5, 6, 7], data[3:])
        for k, q in enumerate(prints):
            error, match, offset = min((brute(p, q)[0], j, brute(p, q)[1]) for j, p in enumerate(prints) if j != k)
            assert state.best[k][0] == pytest.approx(error)
            assert state.best[k][1:3] == (match, offset)


def test_query_finds_the_best_of_all(spark):
    media = {r["rec_id"]: chroma.fingerprint(r["audio"]) for r in chroma.sonified_table(spark, "/root/testdata/sf0.001").collect()}
    found = {r["rec_id"]: r for r in chroma.op2_chroma_fingerprints(spark, "/root/testdata/sf0.001").filter("rec_id % 50 = 0 AND class_id IS NOT NULL").collect()}
    assert len(found) == 10
    for k, r in found.items():
        error, match = min((brute(p, media[k])[0], j) for j, p in media.items() if j != k)
        assert r["match_id"] == match and r["bit_error"] == pytest.approx(error)


@pytest.mark.parametrize("part", [3, 2048])
def test_identical_silent_recordings_and_excerpts(spark, monkeypatch, part):
    """Many equal recordings are one class; excerpts, shifted and noisy, find what they are of."""
    import io
    import wave

    def wav(values):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(chroma.RATE)
            w.writeframes(np.round(values * 30000).astype("<i2").tobytes())
        return out.getvalue()

    monkeypatch.setattr(chroma, "PART", part)
    rng = np.random.default_rng(3)
    tunes = [chroma.notes()[rng.integers(0, 25, 40)].ravel() / 32768 for _ in range(8)]
    rows = [(k, wav(t)) for k, t in enumerate(tunes)]
    rows += [(50 + k, wav(np.clip(t[10 * chroma.HOP : 60 * chroma.HOP] + rng.normal(scale=0.005, size=50 * chroma.HOP), -1, 1))) for k, t in enumerate(tunes)]
    rows += [(1000 + k, wav(np.zeros(9000))) for k in range(300)] + [(None, wav(np.zeros(9000)))]
    found = {r["rec_id"]: r for r in chroma.align(spark.createDataFrame(rows, "rec_id long, audio binary"), lambda c: (c >= 50) & (c < 58) | (c == 1000) | (c == 1007)).collect()}
    for k in range(8):
        r = found[50 + k]
        assert (r["match_id"], r["match_offset"]) == (k, 10) and r["bit_error"] < 0.15
    assert {found[1000 + k]["class_id"] for k in range(300)} == {1000}
    assert (found[1000]["match_id"], found[1007]["match_id"], found[1007]["bit_error"]) == (1001, 1000, 0)
    assert found[1001]["match_id"] is None
