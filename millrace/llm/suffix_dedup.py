"""Removal of byte strings that occur more than once, by bucket-pointer refinement.

Wanted: every byte covered by a string of ``length`` bytes that also starts anywhere else. Starts
are sorted into buckets of equal strings of growing length: initial q-gram buckets (q is an eighth
of the length) are refined by the buckets at later offsets, and refined buckets are used again for
the next refinement. It goes in levels (half the length, then the length): a level looks only at
starts whose string of the level before is repeated, since any part of a repeated string is.

To touch as few positions as possible, each start of a level is assigned to an anchor: the q-gram
of least hash among those within its string. Equal strings have equal anchors at equal offsets, so
a start whose anchor's bucket is single is done. Starts with one anchor in common are adjacent and
form a range; where the bucket of the whole range (the bytes that its strings cover) repeats, all
its starts repeat. Ranges with a shared anchor and another surrounding, such as those at the ends
of a copied passage, are refined start by start: bucket numbers at each place are sorted in pairs
with those one length later, numbered anew, and doubled again until the level's length is reached.

Each bucket is counted after partial aggregation, so a passage that most documents share costs a
row a task. Anchors with more than ``GROUP`` different ranges are not gathered: their refined
buckets are counted by an aggregation as well, and the starts of repeated ones are joined back.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` lose nothing;
matches never cross texts; rows with an equal id are separate documents (told apart by hashes of id
and text; rows that are equal in both lose the same bytes); an empty table gives no rows.

Texts that share any anchor are written once, in buckets, so that the lists of their ranges and
starts come to them without moving them again.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, bucketed, forget, read, small_or_shuffled, written

LENGTH = 400
#: Bytes of text hashed at once; a longer text is hashed on its own, in overlapping parts.
CHUNK = 1 << 19
PART = 1 << 22
#: Low bits of an identifier that give way to a place; the same everywhere, so that equal strings
#: have equal anchors.
PLACE = np.uint64((1 << 24) - 1)
BASE = 0x9E3779B97F4A7C15 | 1
MASK64 = (1 << 64) - 1
#: Different ranges of one anchor that are refined in one task.
GROUP = 2048


@lru_cache(1)
def byte_values() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


class Powers:
    """Powers of the base and of its inverse modulo 2^64; grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 1024)
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread bits: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of value times power up to each place, and the inverse powers."""
    up, down = POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values()[data] * up[: len(data)], out=sums[1:])
    return sums, down


def bucket_ids(sums: np.ndarray, down: np.ndarray, q: int) -> np.ndarray:
    """Identifier of the q-gram bucket at each place."""
    n = len(sums) - q
    return mix((sums[q:] - sums[:n]) * down[:n])


def window_argmin(ids: np.ndarray, width: int) -> np.ndarray:
    """For each place, where the least of the next ``width`` ids stands, leftmost of equals.
    The low bits of an id give way to its place; equal windows still agree."""
    n = len(ids) - width + 1
    tagged = (ids & ~PLACE) | np.arange(len(ids), dtype=np.uint64)
    padded = np.full(-(-len(ids) // width) * width, np.uint64(MASK64))
    padded[: len(ids)] = tagged
    grid = padded.reshape(-1, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(backward[:n], forward[width - 1 : width - 1 + n]) & PLACE).astype(np.int64)


def levels(length: int) -> list[tuple[int, int]]:
    """String length and length of the buckets that its anchors are, for each level."""
    return [(max(2, length // 2), max(1, length // 8)), (length, max(1, length // 2))]


def ranges(texts: list[bytes], length: int = LENGTH, q: int | None = None, runs: list | None = None) -> tuple[np.ndarray, ...]:
    """text number, first start, last start, anchor bucket, range bucket of all ranges of starts:
    of all starts, or of those in ``runs`` (for each text, first and last start of its runs)."""
    q = q or length // 2
    width = length - q + 1
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    # (text, place of its first byte, bytes); parts of one run overlap by one byte less than length.
    usable = [
        (i, p, t[p : min(p + PART - 1, last) + length])
        for i, t in enumerate(texts)
        for first, last in ([(0, len(t) - length)] if runs is None else runs[i])
        for p in range(first, last + 1, PART)
    ]
    at = 0
    while at < len(usable):
        chosen, total = [], 0
        while at < len(usable) and (not chosen or total + len(usable[at][2]) <= CHUNK):
            chosen.append(usable[at])
            total += len(usable[at][2])
            at += 1
        data = np.frombuffer(b"".join(t for _, _, t in chosen), np.uint8)
        sizes = np.array([len(t) for _, _, t in chosen])
        number, base = np.array([i for i, _, _ in chosen]), np.array([p for _, p, _ in chosen])
        firsts = np.cumsum(sizes) - sizes
        sums, down = prefix_hashes(data)
        ids = bucket_ids(sums, down, q)
        least = window_argmin(ids, width)
        # Starts within a part: all but its last length - 1 places.
        last_start = firsts + sizes - length
        change = np.zeros(len(data) + 1, np.int32)
        change[firsts] += 1
        change[last_start + 1] -= 1
        starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        anchor = least[starts]
        part = np.searchsorted(firsts, starts, side="right") - 1
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
        lo, hi = starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])]
        m, part = anchor[np.concatenate([[0], cut])], part[np.concatenate([[0], cut])]
        shape = ((hi - lo).astype(np.uint64) << np.uint64(32)) | (m - lo).astype(np.uint64)
        whole = mix(((sums[hi + length] - sums[lo]) * down[lo]) ^ mix(shape))
        for column, value in zip(out, (number[part], lo - firsts[part] + base[part], hi - firsts[part] + base[part], ids[m].view(np.int64), whole.view(np.int64))):
            column.append(value)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def start_ids(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Refined bucket of each start in ``data`` at which a string fits, by a pair of identifiers:
    of the bucket of its first half and of the one at the later offset."""
    q = -(-length // 2)
    sums, down = prefix_hashes(np.frombuffer(data, np.uint8))
    ids = bucket_ids(sums, down, q)
    n = len(data) - length + 1
    return ids[:n].view(np.int64), ids[length - q : length - q + n].view(np.int64)


def renumbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of equal keys, and whether a bucket has further members, for each place."""
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    return number.astype(np.int64), count[number] > 1


def repeated_starts(pieces: list[bytes], length: int, q: int) -> list[np.ndarray]:
    """For each piece, which of its starts have a string of ``length`` bytes that starts elsewhere
    in the pieces too.

    The refinement: q-gram buckets first; then places are sorted by the pair of their bucket and
    the one ``h`` bytes later, and numbered anew, with ``h`` doubled each time. Places that are
    alone in their bucket go on no further, and neither does what such a place would end.
    """
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    firsts = np.cumsum(sizes) - sizes
    number, shared = renumbered(bucket_ids(*prefix_hashes(data), q))
    # Places whose string would cross into the next piece are no members of any bucket.
    left = np.repeat(firsts + sizes, sizes) - np.arange(len(data))
    h = q
    while h < length:
        step = min(h, length - h)
        n = len(number) - step
        going = np.flatnonzero(shared[:n] & shared[step:] & (left[:n] >= h + step))
        refined, again = renumbered(number[going] * len(data) + number[going + step])
        number, shared = np.full(n, -1, np.int64), np.zeros(n, bool)
        number[going], shared[going] = refined, again
        h += step
    return [shared[a : a + n - length + 1] for a, n in zip(firsts.tolist(), sizes.tolist())]


def encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


KEY = ["uid", "tag"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and what tells rows apart: uid and tag, hashes of both."""
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(F.xxhash64(doc_id, "text").alias("uid"), F.hash("text", doc_id).alias("tag"), doc_id.alias("doc_id"), "text")


SPANS = "array<struct<s: int, e: int>>"


def runs_of(flags: np.ndarray, lo: int) -> list[tuple[int, int]]:
    """First and last place of each run of set flags, counted from ``lo``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(lo + a, lo + b - 1) for a, b in edge.reshape(-1, 2).tolist()]


def joined_runs(spans: list) -> list[tuple[int, int]]:
    """Sorted runs of starts, touching and overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for x in spans or ():
        s, e = x["s"], x["e"]
        if out and s <= out[-1][1] + 1:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def all_ranges(texts: DataFrame, length: int, q: int, before: int) -> DataFrame:
    """Ranges of all starts of ``texts`` (uid, tag, text, spans), or if ``before`` is not zero of
    those that can be repeated: between the first and last start of a run of repeated strings of
    ``before`` bytes, less what the string is longer."""

    def setup():
        def kernel(uids, tags, texts, spans):
            data = [encoded(t) for t in texts]
            runs = [[(s, e - length + before) for s, e in joined_runs(x)] for x in spans] if before else None
            text, lo, hi, anchor, whole = ranges(data, length, q, runs)
            place = text.tolist()
            return [uids[i] for i in place], [tags[i] for i in place], lo.astype(np.int32), hi.astype(np.int32), anchor, whole

        return kernel

    return arrow_map(texts, [*KEY, "text", "spans"], "uid long, tag int, lo int, hi int, anchor long, whole long", setup)


def shared_ranges(texts: DataFrame, length: int, q: int, before: int) -> DataFrame:
    """Written: the ranges whose anchor stands in others too, and whether all of those are alike."""
    every = written(all_ranges(texts, length, q, before))
    shared = written(every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most")).filter("n > 1").select("anchor", (F.col("least") == F.col("most")).alias("alike")))
    found = written(every.join(small_or_shuffled(shared, shared.count(), 16), "anchor"))
    forget(every)
    return found


def repeated_in(held: DataFrame, candidates: DataFrame, length: int, q: int) -> DataFrame:
    """Written: uid, tag, spans: sorted runs (first and last) of the starts whose string of
    ``length`` bytes is repeated, for the documents that have any. ``held`` are the texts."""
    runs = lambda df: df.select(*KEY, F.col("lo").alias("s"), F.col("hi").alias("e"))
    unlike = candidates.filter("NOT alike")
    kinds = written(
        unlike.groupBy("anchor", "whole")
        .agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "lo", "hi")).alias("one"))
        .select("anchor", "whole", "n", "one.*")
    )
    several = kinds.filter("n > 1").select("anchor", "whole")
    also = unlike.join(small_or_shuffled(several, several.count(), 16), ["anchor", "whole"], "left_semi")
    spans = runs(candidates.filter("alike")).unionByName(runs(also)).unionByName(refined(held, kinds, length, q))
    return written(spans.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans")))


def refined(held: DataFrame, kinds: DataFrame, length: int, q: int) -> DataFrame:
    """Runs (uid, tag, s, e) of repeated starts in ranges whose anchor other ranges share.

    ``kinds``: anchor, whole, n (ranges of that kind), uid, tag, lo, hi of one of them.
    """
    # Few, since each has more than GROUP kinds.
    crowded = written(kinds.groupBy("anchor").agg(F.count("*").alias("k")).filter(F.col("k") > GROUP).select("anchor", F.lit(True).alias("many")))
    marked = kinds.join(small_or_shuffled(crowded, crowded.count(), 16), "anchor", "left").withColumn("crowded", F.coalesce("many", F.lit(False)))
    listed = marked.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "n", "crowded", "lo", "hi")).alias("found"))
    # Equal rows would come twice; then n > 1 for all their ranges, and nothing hangs on the count.
    texts = held.join(listed, KEY)
    few, many = (texts.withColumn("found", F.expr(f"filter(found, x -> x.crowded = {c})")).filter(F.size("found") > 0) for c in ("false", "true"))
    return gathered(few, length, q).unionByName(counted(many, length))


def gathered(texts: DataFrame, length: int, q: int) -> DataFrame:
    """Runs of repeated starts, the ranges of one anchor in one task (at most ``GROUP``)."""
    import pandas as pd

    def setup():
        def kernel(uids, tags, texts, found):
            out: list[list] = [[] for _ in range(6)]
            for i, tag, text, entries in zip(uids, tags, texts, found):
                data = encoded(text)
                for x in entries:
                    for column, value in zip(out, (x["anchor"], i, tag, x["n"] == 1, x["lo"], data[x["lo"] : x["hi"] + length])):
                        column.append(value)
            return out

        return kernel

    rows = arrow_map(texts, [*KEY, "text", "found"], "anchor long, uid long, tag int, single boolean, lo int, bytes binary", setup, 64)
    dealt = rows.repartition("anchor").sortWithinPartitions("anchor")

    def flush(held: list) -> list[tuple]:
        if len(held) < 2:
            return []
        flags = repeated_starts([r.bytes for r in held], length, q)
        return [(r.uid, r.tag, s, e) for r, f in zip(held, flags) if r.single for s, e in runs_of(f, r.lo)]

    def refine(batches):
        held, anchor = [], None
        for batch in batches:
            done: list[tuple] = []
            for r in batch.itertuples(index=False):
                if r.anchor != anchor:
                    done += flush(held)
                    held, anchor = [], r.anchor
                held.append(r)
            if done:
                yield pd.DataFrame(done, columns=[*KEY, "s", "e"])
        if done := flush(held):
            yield pd.DataFrame(done, columns=[*KEY, "s", "e"])

    return dealt.mapInPandas(refine, "uid long, tag int, s int, e int")


def counted(texts: DataFrame, length: int) -> DataFrame:
    """Runs of repeated starts of crowded anchors: refined buckets are counted after partial
    aggregation, so that no task holds all the members of one."""

    def setup():
        def kernel(uids, tags, texts, found):
            out: list[list] = [[] for _ in range(6)]
            for i, tag, text, entries in zip(uids, tags, texts, found):
                data = encoded(text)
                for x in entries:
                    first, second = start_ids(data[x["lo"] : x["hi"] + length], length)
                    for column, value in zip(out, ([i] * len(first), [tag] * len(first), [x["n"] == 1] * len(first), range(x["lo"], x["hi"] + 1), first.tolist(), second.tolist())):
                        column.extend(value)
            return out

        return kernel

    rows = written(arrow_map(texts, [*KEY, "text", "found"], "uid long, tag int, single boolean, s int, first long, second long", setup, 16))
    again = written(rows.groupBy("first", "second").agg(F.count("*").alias("n")).filter("n > 1").select("first", "second"))
    return rows.filter("single").join(small_or_shuffled(again, again.count(), 24), ["first", "second"], "left_semi").select(*KEY, "s", F.col("s").alias("e"))


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """The texts that repeat anything (doc_id, text, uid, tag; in buckets), and for each level its
    string length and runs; each level goes on from the runs of the one before."""
    base = keyed(docs)
    (half, q), (whole, r) = levels(length)
    candidates = shared_ranges(base.withColumn("spans", F.lit(None).cast(SPANS)), half, q, 0)
    touched = written(candidates.select(*KEY).distinct())
    held = bucketed(base.join(small_or_shuffled(touched, touched.count(), 16), KEY, "left_semi"), *KEY)
    first = repeated_in(held, candidates, half, q)
    forget(candidates)
    second = repeated_in(held, shared_ranges(held.join(first, KEY), whole, r, half), whole, r)
    return held, [(half, first), (whole, second)]


def merged(spans: list, length: int) -> list[tuple[int, int]]:
    """The bytes that strings at sorted runs of starts cover: disjoint spans, end exclusive."""
    out: list[tuple[int, int]] = []
    for x in spans or ():
        s, e = x["s"], x["e"] + length
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and text without the repeated bytes (characters cut apart become U+FFFD), every row."""
    _, (_, (_, runs)) = repeated_runs(docs, length)

    def setup():
        return lambda ids, texts, spans: (ids, [without(encoded(t), merged(s, length)).decode("utf-8", "replace") if s else t for t, s in zip(texts, spans)])

    return arrow_map(keyed(docs).join(runs, KEY, "left"), ["doc_id", "text", "spans"], "doc_id long, text string", setup)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document and the digest of what remains; besides, its bytes in
    repeated strings of 200 bytes, and the longest run of such bytes (0 for none), which for a
    passage that is repeated as a whole is the passage's length."""
    docs = read(spark, sf_dir, "documents")
    held, ((half, first), (_, second)) = repeated_runs(docs)

    def setup():
        def kernel(uids, tags, texts, halves, spans):
            out: list[list] = [[] for _ in range(5)]
            for text, shorter, found in zip(texts, halves, spans):
                data, runs = encoded(text), merged(found, LENGTH)
                short = [e - s for s, e in merged(shorter, half)]
                row = (sum(e - s for s, e in runs), len(runs), hashlib.sha256(without(data, runs)).hexdigest(), max(short), sum(short))
                for column, value in zip(out, row):
                    column.append(value)
            return [uids, tags, *out]

        return kernel

    texts = held.join(first.withColumnRenamed("spans", "half"), KEY).join(second, KEY, "left")
    made = written(arrow_map(texts, [*KEY, "text", "half", "spans"], "uid long, tag int, n_removed long, n_spans long, sha string, longest int, in_half long", setup).dropDuplicates(KEY))
    # Whole texts without repeats only need their digest, which needs no text to be moved.
    every = keyed(docs).select(*KEY, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("own"))
    zero = lambda c, kind="bigint": F.coalesce(c, F.lit(0)).cast(kind)
    return every.join(small_or_shuffled(made, made.count(), 160), KEY, "left").select(
        "doc_id",
        "n_bytes",
        zero("n_removed").alias("n_removed"),
        zero("n_spans").alias("n_spans"),
        F.coalesce("sha", "own").alias("kept_sha256"),
        zero("longest", "int").alias("longest_repeat"),
        zero("in_half").alias("n_in_repeats_200"),
    )
