"""Line, substring and near-duplicate operators, vectors and audio, against brute force."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, chroma, components, line_dedup, near_dup, simhash, suffix_dedup

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, tag string, lo int, h1 long, key string, pos int"
LONG = "This line stands in many of the documents, unchanged."


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "t", 1, 2, "k", 3) for i, t in rows], COLUMNS)


# --- lines ---


def lines_by_hand(rows, least=5):
    white = " \t\n\x0b\x0c\r"
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(white))
    where = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                where[key(line)].add(i)
    gone = {k: max(x for x in v if x is not None) for k, v in where.items() if len(v) >= least}
    out = []
    for i, t in rows:
        kept = [line for line in (t or "").split("\n") if gone.get(key(line), i) == i]
        out.append((i, "\n".join(kept)))
    return out


def test_lines(spark):
    rows = [(i, f"own {i}\n  {LONG.upper() if i % 2 else LONG}\t\nshort\nÀ {LONG}\n{LONG}") for i in range(7)]
    rows += [(10, None), (11, ""), (12, "\n\n"), (13, LONG + "\x0b"), (14, "É" + LONG), (15, "é" + LONG), (16, "x\n" * 200 + LONG)]
    made = line_dedup.drop_lines(docs(spark, rows))
    assert made.columns == docs(spark, []).columns
    found = sorted((r["doc_id"], r["text"] or "") for r in made.collect())
    assert found == sorted(lines_by_hand(rows))


def test_lines_with_null_and_repeated_ids(spark):
    rows = [(None, LONG + "\nown"), *((i, LONG) for i in (1, 2, 2, 3, 4)), (4, "other")]
    found = [(r["doc_id"], r["text"]) for r in line_dedup.drop_lines(docs(spark, rows)).collect()]
    assert collections.Counter(found) == collections.Counter([(None, "own"), (1, ""), (2, ""), (2, ""), (3, ""), (4, LONG), (4, "other")])
    assert line_dedup.drop_lines(docs(spark, [])).count() == 0
    words = line_dedup.keep_bitmaps(docs(spark, [(i, "\n" * 70 + LONG) for i in range(5)])).filter("doc_id = 0").first()["words"]
    assert [(w["word"], w["keep"]) for w in words] == [(1, ~(1 << 6))]


def test_texts_of_very_many_lines(spark):
    """Bitmaps are applied in one pass, with gaps between their words."""
    rng = random.Random(4)
    texts = [(i, "\n".join(LONG if rng.random() < 0.01 else f"own line {i} {k}" for k in range(40_000 if i == 2 else 500))) for i in range(6)]
    found = sorted((r["doc_id"], r["text"]) for r in line_dedup.drop_lines(docs(spark, texts)).collect())
    assert found == sorted(lines_by_hand(texts))


def test_first_occurrences_are_streamed(spark):
    """One shuffle by range, one sort by hash, document and position, and a running number."""
    plan = line_dedup.first_occurrences(line_dedup.hashed_lines(docs(spark, [(1, LONG)])))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(h1" in plan and "hashpartitioning" not in plan
    assert plan.count("Sort [h1") == 1 and "pos" in plan[plan.index("Sort [h1") :].split("]")[0]


def test_line_query_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = sorted(c.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({line_dedup.OP7_SQL})").fetchall())
    assert sorted(map(tuple, line_dedup.op7_line_dedup(spark, SMALL).collect())) == want


# --- byte strings ---


def covered(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        out.append(bytes(b for b, m in zip(t, mark) if not m))
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40), text(25), "z" * 90, "ab" * 60]
    out = []
    for _ in range(40):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 3)
            parts += [s[a : len(s) - rng.randint(0, len(s) // 3)], text(rng.randint(0, 12))]
        out.append(" ".join(parts))
    return [*out, "", shared[0], shared[0], "z" * 300]


@pytest.mark.parametrize("seed", range(3))
def test_repeats_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(suffix_dedup, "GROUP", 4)
    texts = passages(seed)
    made = suffix_dedup.remove_repeats(docs(spark, list(enumerate(texts))), 40)
    found = {r["doc_id"]: r["text"] for r in made.collect()}
    want = covered([t.encode() for t in texts], 40)
    assert [found[i].encode() for i in range(len(texts))] == [w.decode("utf-8", "replace").encode() for w in want]


def test_long_texts_in_parts(monkeypatch):
    rng = np.random.default_rng(0)
    text = bytes(rng.integers(97, 123, 5000, dtype=np.uint8))
    whole = suffix_dedup.ranges([text], 40)
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    parts = suffix_dedup.ranges([text], 40)
    starts = lambda r: [i for lo, hi in zip(r[1], r[2]) for i in range(lo, hi + 1)]
    assert starts(whole) == starts(parts) == list(range(5000 - 39))


@pytest.mark.parametrize("length,q", [(12, 1), (12, 3), (12, 6), (13, 3), (40, 5), (40, 20)])
def test_refinement_of_starts(length, q):
    rng = random.Random(length + q)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(length, 3 * length))).encode() for _ in range(30)]
    pieces += [pieces[0], pieces[1][3:] + pieces[2]]
    count = collections.Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
    for p, flags in zip(pieces, suffix_dedup.repeated_starts(pieces, length, q)):
        assert flags.tolist() == [count[p[i : i + length]] > 1 for i in range(len(p) - length + 1)]


@pytest.mark.parametrize("length", [50, 100, 200, 400])
def test_runs_of_both_levels(spark, length):
    rng = random.Random(length)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(length + 60)
    texts = [text(rng.randint(0, 3 * length)) + shared[rng.randint(0, length) : rng.randint(length // 2, len(shared))] + text(rng.randint(0, length)) for _ in range(30)]
    held, found_runs = suffix_dedup.repeated_runs(docs(spark, list(enumerate(texts))), length)
    for size, runs in found_runs:
        count = collections.Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
        found = {r["doc_id"]: {i for s, e in suffix_dedup.joined_runs(r["spans"]) for i in range(s, e + 1)} for r in runs.join(held, suffix_dedup.KEY).collect()}
        for n, t in enumerate(texts):
            assert found.get(n, set()) == {i for i in range(len(t) - size + 1) if count[t[i : i + size]] > 1}


def test_substring_query_against_brute_force(spark):
    truth = {i: t.encode() for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()}
    want = dict(zip(truth, covered(list(truth.values()), 400)))
    half = dict(zip(truth, covered(list(truth.values()), 200)))
    for r in suffix_dedup.op8_suffix_dedup(spark, SMALL).collect():
        i = r["doc_id"]
        assert r["kept_sha256"] == hashlib.sha256(want[i]).hexdigest()
        assert (r["n_bytes"], r["n_removed"]) == (len(truth[i]), len(truth[i]) - len(want[i]))
        assert r["n_in_repeats_200"] == len(truth[i]) - len(half[i])
        assert (r["longest_repeat"] >= 200) == (r["n_in_repeats_200"] > 0)
        assert r["longest_repeat"] <= r["n_in_repeats_200"] and (r["longest_repeat"] >= 400 or not r["n_removed"])


def test_substring_edges(spark):
    text = "x" * 10 + "".join(map(str, range(200)))
    rows = [(1, text), (1, text), (1, "different"), (None, None), (None, text[:400]), (2, "")]
    found = collections.Counter((r["doc_id"], r["text"]) for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect())
    tail = text[500:] if len(text) < 500 else ""
    assert sum(found.values()) == 6
    assert found[(1, "different")] == found[(None, None)] == found[(2, "")] == 1
    assert found[(1, tail)] == 2
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


# --- fingerprints ---


def fingerprint_by_hand(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_spark_hash(spark):
    for t in (None, "", "One", "É É two", "a b c d e A B C", "x\x0by\x1cz w", "w " * 5000):
        assert simhash.fingerprint(t) == fingerprint_by_hand(t)
    one = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    import xxhash

    assert one & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_golay_code():
    by_byte, error, near = simhash.golay_tables()
    words = np.random.default_rng(0).integers(0, 1 << 23, 200)
    code = np.array([m << 11 ^ simhash.remainder(m << 11) for m in range(4096)])
    for w in words.tolist():
        s = by_byte[0][w & 255] ^ by_byte[1][w >> 8 & 255] ^ by_byte[2][w >> 16]
        index = (w ^ int(error[s])) >> 11
        distance = np.bitwise_count(code ^ w)
        assert distance[index] == distance.min() <= 3
        assert {int(index ^ m) for m in near[s] if m >= 0} == set(np.flatnonzero(distance <= 4).tolist())


def linked(values, distance):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if int(values[i] ^ values[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("group", [4096, 3])
def test_links_find_all_pairs_up_to_three_bits(spark, group):
    rng = random.Random(group)
    values = [rng.getrandbits(64) for _ in range(30)]
    for v in values[:20]:
        for _ in range(4):
            x = v
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            values.append(x)
    values = sorted(set(values) | {0, 1, 7})
    nodes = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    roots = dict(map(tuple, components.components(simhash.links(nodes, 3, group)).collect()))
    want = linked(values, 3)
    same = lambda f: {frozenset(j for j in range(len(values)) if f(j) == f(i)) for i in range(len(values))}
    assert same(lambda i: roots.get(simhash.signed(values[i]), simhash.signed(values[i]))) == same(lambda i: want[i])


def test_components_of_a_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5), (1001, 1000)], "a long, b long").repartition(7)
    found = dict(map(tuple, components.components(edges).collect()))
    assert found == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000}
    assert components.components(edges.limit(0)).count() == 0


def test_classes(spark):
    rows = [(3, "one two three four"), (1, "One two THREE four"), (2, "entirely different words in here"), (4, None), (5, ""), (5, ""), (None, "one two three four")]
    found = collections.Counter((r["doc_id"], r["component_id"]) for r in simhash.classes(docs(spark, rows)).collect())
    assert found == collections.Counter({(3, 1): 1, (1, 1): 1, (2, 2): 1, (4, 4): 1, (5, 4): 2, (None, 1): 1})
    assert simhash.classes(docs(spark, [])).count() == 0


def test_simhash_query_against_brute_force(spark):
    truth = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()
    values = [fingerprint_by_hand(t) for _, t in truth]
    want = {truth[i][0]: (f"{values[i]:016x}", truth[r][0]) for i, r in enumerate(linked(values, 3))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op9_simhash_golay(spark, SMALL).collect()} == want


# --- near-duplicates at a similarity ---


def test_near_duplicates(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, want = [], set()
    for k in range(25):
        base = [word() for _ in range(200)]
        rows.append((100 * k, " ".join(base)))
        want.add(100 * k)
        for j in range(3):
            copy = list(base)
            for p in rng.sample(range(200), 2):
                copy[p] = word()
            rows.append((100 * k + 1 + j, "  ".join(copy).upper() if j else "\n".join(copy)))
        apart = list(base)
        for p in range(0, 200, 8):
            apart[p] = word()
        rows.append((100 * k + 50, " ".join(apart)))
        want.add(100 * k + 50)
    rows += [(9000, None), (9001, ""), (9002, "few words"), (9003, "Few  words"), (9003, "few words"), (None, "alone here")]
    want |= {9000, 9002, None}
    made = near_dup.drop_near_duplicates(docs(spark, rows))
    assert made.columns == docs(spark, []).columns
    found = [r["doc_id"] for r in made.collect()]
    assert len(found) == len(set(found))
    assert set(found) == want
    assert near_dup.drop_near_duplicates(docs(spark, [])).count() == 0


# --- vectors ---


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id long, embedding array<float>, label int, score double")


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 24)) + 3 * rng.normal(size=(6, 24))[rng.integers(0, 6, 600)]
    x[40:60] = x[40]
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 24), (1002, [None] + [1.0] * 23), (1003, [float("nan")] + [1.0] * 23), (1004, [float("inf")] * 24), (None, [1.0] * 24), (1005, [1.0] * 3)]
    frame = ann.usable(vectors(spark, rows + odd))
    coder = ann.fit(frame, sample_rows=200, n_centroids=4)
    found = ann.search(ann.build_index(frame, coder), frame.filter("vec_id % 20 = 0"), coder).toPandas()
    values = np.array([r for _, r in rows])
    hits = total = 0
    for q in range(0, 600, 20):
        d = np.sqrt(((values - values[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        got = found[found.query_id == q].sort_values("rank")
        assert np.allclose(got.score, d[got.vec_id])
        hits, total = hits + len(set(want) & set(got.vec_id)), total + 10
    assert hits >= 0.9 * total
    assert list(found[found.query_id == 40].sort_values("rank").vec_id) == list(range(41, 51))


def test_search_edges(spark):
    few = ann.usable(vectors(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (1, [1.0, 2.5])]))
    coder = ann.fit(few)
    assert [tuple(r)[:3] for r in ann.search(ann.build_index(few, coder), few.filter("vec_id = 0"), coder).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 1)]
    none = ann.usable(vectors(spark, [(0, None)]))
    assert ann.fit(none) == {}
    assert ann.search(ann.build_index(none, {}), none, {}).count() == 0
    # Every dimension has its own model; a vector alone in its dimension finds nothing.
    mixed = ann.usable(vectors(spark, [(i, [float(i + 1)] * (2 + i % 2)) for i in range(9)] + [(10, [1.0] * 5)]))
    coder = ann.fit(mixed)
    found = ann.search(ann.build_index(mixed, coder), mixed.filter("vec_id IN (0, 1, 10)"), coder).toPandas().sort_values("rank")
    assert list(found[found.query_id == 0].vec_id) == [2, 4, 6, 8] and list(found[found.query_id == 1].vec_id) == [3, 5, 7]
    assert 10 not in set(found.query_id)


@pytest.mark.parametrize("part", [64, 8192])
def test_vector_query_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(ann, "PART", part)
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet'").fetchall()
    ids, x = np.array([i for i, _ in table]), np.array([v for _, v in table], float)
    found = ann.op3_rotated_codes(spark, SMALL).toPandas()
    assert set(found.query_id) == set(ids[ids % 100 == 0].tolist())
    hits = 0
    for q, got in found.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        want = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        got = got.sort_values("rank")
        assert list(got["rank"]) == list(range(1, 11))
        assert np.allclose(got.score, [d[ids == v][0] for v in got.vec_id])
        hits += len(set(want) & set(got.vec_id))
    assert hits >= 0.9 * len(found)


def test_error_bound_holds():
    """Also with the query rounded to eight bits; and few pairs lie within it for nothing."""
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(2000, 64)), rng.normal(size=(20, 64))
    coder = ann.Coder(np.linalg.qr(rng.normal(size=(256, 64)))[0], x[:1] * 0, 0)
    near, code, length, inner = coder.encode(x)
    estimate, lower = ann.bounds(coder, 0, code, length, inner, q, 3.0)
    exact = ((x[:, None] - q[None]) ** 2).sum(2)
    assert (lower <= exact).mean() > 0.998
    assert abs((estimate - exact).mean()) < 0.02 * exact.mean()
    limits = np.sqrt(np.partition(exact, 9, axis=0)[9])
    who, place, score, compared = ann.probe(coder, 0, np.arange(2000), code, length, inner, x, -np.arange(1, 21), q, np.full(20, np.inf), 10, 3.0)
    assert sum(score <= limits[who] + 1e-9) >= 0.9 * 200 and len(who) == 200
    assert compared < 0.25 * exact.size


# --- audio ---


def wav(values, rate=chroma.RATE):
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.round(np.clip(values, -1, 1) * 30000).astype("<i2").tobytes())
    return out.getvalue()


def melody(seed, n=40):
    pitch = np.random.default_rng(seed).integers(0, 25, n)
    return chroma.notes()[pitch].ravel() / 32768


def test_codes_of_a_filter_by_hand():
    image = np.random.default_rng(1).random((20, 12))
    k, (kind, y, h, w) = 2, chroma.filters()[2]
    assert kind == 2
    value = np.log1p(image[w // 2 : w, y : y + h].sum()) - np.log1p(image[: w // 2, y : y + h].sum())
    level = int(np.digitize(value, (-0.35, 0.0, 0.35)))
    assert int(chroma.codes(image)[0]) >> (2 * k) & 3 == level ^ level >> 1


def test_alignment_of_shifted_and_noisy_recordings(spark):
    base = melody(1)
    noise = np.random.default_rng(9).normal(scale=0.01, size=len(base))
    shifted = np.concatenate([melody(2, 10)[: 10 * chroma.HOP], base])
    rows = [(0, wav(base)), (1, wav(shifted)), (2, wav(base + noise)), (3, wav(melody(3))), (4, wav(melody(3))), (5, None), (6, b"junk"), (7, wav(base[:100])), (50, wav(melody(4)))]
    media = spark.createDataFrame([(i, a, "x", 1) for i, a in rows], "rec_id long, audio binary, codes string, class_id int")
    found = {r["rec_id"]: r for r in chroma.align(media, lambda c: c.isin(0, 3, 4, 50)).collect()}
    assert set(found) == {i for i, _ in rows}
    assert found[0]["match_id"] in (1, 2)
    assert found[0]["bit_error"] < 0.2
    alone = {r["rec_id"]: r for r in chroma.align(media.filter("rec_id in (0, 1)"), lambda c: c == 0).collect()}
    assert (alone[0]["match_id"], alone[0]["match_offset"]) == (1, 10)
    assert (found[3]["class_id"], found[4]["class_id"], found[3]["match_id"], found[4]["match_id"]) == (3, 3, 4, 3)
    assert found[3]["bit_error"] == 0
    assert all(found[i]["n_codes"] == 0 and found[i]["class_id"] is None for i in (5, 6, 7))
    assert found[50]["match_id"] is None or found[50]["bit_error"] > 0.2
    assert chroma.align(media.limit(0), lambda c: c == 0).count() == 0


def test_audio_query(spark):
    found = chroma.op2_chroma_fingerprints(spark, SMALL).toPandas()
    assert found.rec_id.is_unique
    assert (found.n_codes > 0).all()
