"""Near-duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into four segments of 16 bits. If two fingerprints differ in at most
three bits, some segment is equal in both, and of any two further segments at least one differs in
at most one bit (two and two would be four). For that segment, padded to 23 bits, the perfect
Golay code gives fuzzy keys: the one codeword within distance 3 of a word lies within distance 4
of any word one bit away, and at most six codewords do. So one side of the join carries the index
of its nearest codeword, the other the indices of all codewords within distance 4, each together
with the equal segment: 28-bit keys. Candidates that share a key are verified on all 64 bits.

A key's group is not expanded into pairs: its task verifies in blocks and returns a forest, at most
one edge a member. Groups larger than ``GROUP`` are dealt into block pairs first. Components come
from those edges. Equal fingerprints are one node throughout.

Defined cases: null, empty and blank texts have fingerprint zero, which links like any other; texts
with fewer words than a shingle are one shingle; repeated rows share a component; a null doc_id is
never a component's id unless the component has no other; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, attach, read, small_or_shuffled, written
from millrace.llm.components import components, forest

SEED = 42
SEGMENTS, BITS = 4, 16
#: (equal segment, fuzzy segment): for each equal one, two of the others.
KEYS = tuple((i, j) for i in range(SEGMENTS) for j in ((i + 1) % SEGMENTS, (i + 2) % SEGMENTS))
#: Members of one key's group on its exact side that one task takes at once.
GROUP = 4096
#: Generator of the binary Golay code of length 23: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a whole text's shingles, repeats included."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    k = min(words, len(parts))
    joined = b" ".join(parts)
    sizes = list(map(len, parts))
    starts = list(accumulate(sizes[:-1], lambda at, n: at + n + 1, initial=0))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b + n], SEED) for a, b, n in zip(starts, starts[k - 1 :], sizes[k - 1 :])], dtype=">u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Each bit that more than half of the hashes have; in blocks, so memory stays bounded."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 16384):
        counts += np.unpackbits(hashes[i : i + 16384].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for every row."""

    def setup():
        return lambda ids, texts: (ids, [signed(fingerprint(t, words)) for t in texts])

    return arrow_map(docs, [F.col("doc_id").cast("bigint").alias("doc_id"), "text"], "doc_id long, fp long", setup)


# --- Golay code ---


def remainder(word: int) -> int:
    """Syndrome of a 23-bit word."""
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GOLAY << (bit - 11)
    return word


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes by byte (3 x 256); for each syndrome the error of weight at most 3; and for each
    syndrome the codeword indices, relative to the nearest codeword's, within distance 4 (six
    places, -1 for none)."""
    by_byte = np.array([[remainder(b << (8 * k)) if b << (8 * k) < 1 << 23 else 0 for b in range(256)] for k in range(3)], dtype=np.int64)
    single = [remainder(1 << i) for i in range(23)]
    error = np.zeros(2048, dtype=np.int64)
    for i in range(23):
        error[single[i]] = 1 << i
        for j in range(i):
            error[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                error[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    sevens = [c for m in range(4096) if ((c := m << 11 ^ remainder(m << 11)).bit_count() == 7)]
    near = np.full((2048, 6), -1, dtype=np.int64)
    near[:, 0] = 0
    for s in range(2048):
        e = int(error[s])
        if e.bit_count() == 3:  # only then are others within 4: words of weight 7 that contain the error
            near[s, 1:] = [c >> 11 for c in sevens if c & e == e]
    return by_byte, error, near


def keys_of(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, row number and side (0: nearest codeword, 1: codewords within 4) for fingerprints."""
    by_byte, error, near = tables
    segment = [(fps >> np.uint64(BITS * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(SEGMENTS)]
    rows, out = np.arange(len(fps)), []
    for n, (i, j) in enumerate(KEYS):
        word = segment[j]
        syndrome = by_byte[0][word & 255] ^ by_byte[1][word >> 8 & 255] ^ by_byte[2][word >> 16]
        index = (word ^ error[syndrome]) >> 11
        prefix = np.int64(n) << 28 | segment[i] << 12
        out.append((prefix | index, rows, np.zeros(len(fps), np.int8)))
        masks = near[syndrome]
        for c in range(6):
            has = masks[:, c] >= 0
            out.append((prefix[has] | (index[has] ^ masks[has, c]), rows[has], np.ones(int(has.sum()), np.int8)))
    return tuple(np.concatenate(x) for x in zip(*out))


def key_rows(batches):
    tables = golay_tables()
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for start in range(0, len(fps), 8192):
            part = fps[start : start + 8192]
            keys, rows, side = keys_of(part.view(np.uint64), tables)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows]), pa.array(side)], names=["key", "fp", "side"])


def group_edges(exact: np.ndarray, fuzzy: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of all verified pairs of one group, verified in blocks. A
    fingerprint's own pair (distance zero) is left out."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = max(1, (1 << 22) // max(1, len(exact)))
    for start in range(0, len(fuzzy), step):
        part = fuzzy[start : start + step]
        near = np.bitwise_count(part.view(np.uint64)[:, None] ^ exact.view(np.uint64)[None, :]) <= distance
        i, j = np.nonzero(near)
        new_a, new_b = part[i], exact[j]
        other = new_a != new_b
        if other.any():
            a, b = forest(np.concatenate([a, new_a[other]]), np.concatenate([b, new_b[other]]))
    return a, b


def edges_in_order(distance: int):
    """Kernel over rows sorted by group: each group's forest. Groups may span batches."""

    def finish(groups, fps, sides):
        cuts = np.flatnonzero(np.any(np.diff(groups, axis=0) != 0, axis=1)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fps)]])
        found = []
        has_two = np.flatnonzero(ends - starts > 1)
        for k in has_two:
            part, side = fps[starts[k] : ends[k]], sides[starts[k] : ends[k]]
            exact, fuzzy = np.unique(part[side == 0]), np.unique(part[side == 1])
            if len(exact) and len(fuzzy) and (len(exact) > 1 or len(fuzzy) > 1):
                a, b = group_edges(exact, fuzzy, distance)
                if len(a):
                    found.append((a, b))
        if found:
            a, b = forest(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        return None

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            now = (groups, batch.column(3).to_numpy(), batch.column(4).to_numpy())
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now))
            last = np.flatnonzero(np.any(now[0] != now[0][-1], axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut and (out := finish(*(x[:cut] for x in now))) is not None:
                yield out
            held = tuple(x[cut:] for x in now)
        if held is not None and (out := finish(*held)) is not None:
            yield out

    return run


def links(nodes: DataFrame, distance: int = 3, group: int = GROUP) -> DataFrame:
    """a, b: edges between fingerprints of ``nodes`` (fp, distinct) whose components are those of
    all pairs at ``distance`` (at most 3) or fewer bits."""
    if not 0 <= distance <= 3:
        raise ValueError("the keys find pairs at up to three bits")
    rows = written(nodes.select("fp").mapInArrow(key_rows, "key long, fp long, side byte"))
    # Keys with a single member on the exact side and itself on the other cannot link; the count
    # also tells which groups are too large for a task.
    sizes = rows.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("exact"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    useful = written(sizes.filter("exact > 0 AND lo <> hi").select("key", F.ceil(F.col("exact") / group).cast("int").alias("parts")))
    n = useful.count()
    kept = rows.join(small_or_shuffled(useful, n, 12), "key")
    own, every = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = (
        kept.withColumn("own", own)
        .withColumn("each", F.explode(every))
        .select("key", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("each")).alias("i"), F.when(F.col("side") == 0, F.col("each")).otherwise(F.col("own")).alias("j"), "fp", "side")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )
    return dealt.mapInArrow(edges_in_order(distance), "a long, b long")


def classes(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) for every row."""
    each = written(fingerprints(docs, words))
    nodes = written(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes, distance, GROUP))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted)
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = written(rooted.join(ids, "root").select("fp", "component_id"))
    return each.join(small_or_shuffled(named, named.count(), 16), "fp").select("doc_id", "fp", "component_id")


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
