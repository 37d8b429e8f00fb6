"""Packing documents into sequences of bounded length by a grouping genetic algorithm.

An individual is a set of bins. Crossover injects whole well-filled bins of one parent into the
other, removes the bins that would then hold a document twice, and puts the displaced documents
back by best fit. Pieces are dealt into blocks of bounded size; every block is evolved on several
islands (rows of a DataFrame), which between epochs send their best individual to the next island.
Every block goes through the same number of generations and migrations, whatever its size and
however good its first individual is. What lies in poorly filled bins of all blocks is pooled and
packed once more.

Defined cases: null and empty texts are one end-of-document token; documents longer than a
sequence are cut, the first piece being the shorter one; repeated rows are packed each on its own;
an empty table gives no pieces. Columns besides id and text are not read.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, read, written

CAPACITY = 2048


class TextIds:
    """Ids as little-endian unsigned 32-bit bytes.

    The vocabulary is read from a ``tokenizers`` file. If its merges are ordered by id, as they
    are in byte-level files of this kind, ids are ranks and a rank encoder gives the same ids
    faster; if not, the ``tokenizers`` library itself encodes.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        from tokenizers import Tokenizer

        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        order = [vocab[a + b] for a, b in merges]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if order == sorted(order):
            import tiktoken

            plain = byte_alphabet()
            ranks = {bytes(plain[c] for c in t): i for t, i in vocab.items() if t not in self.specials}
            encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.plain = lambda text: encoding.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        else:
            tokenizer = Tokenizer.from_file(path)
            self.plain = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """A whole text; special tokens' strings stand for their ids, as in the library. Null and
        empty texts have no ids."""
        if not text:
            return b""
        for content, number in self.specials.items():
            if content in text:
                return number.to_bytes(4, "little").join(map(self.encode, text.split(content)))
        return self.plain(text)


@lru_cache(1)
def shared_ids(path: str, pattern: str) -> TextIds:
    """One encoder a process, whatever the number of its tasks."""
    return TextIds(path, pattern)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters stand for themselves, the other bytes are counted up from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, eod: int = 0) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and uid, which numbers
    the pieces of the written result."""

    def setup():
        import public_tokenizers

        encoder = shared_ids(path or default_path(), public_tokenizers.PATTERN)
        tail = eod.to_bytes(4, "little")

        def kernel(ids, texts):
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, text in zip(ids, texts):
                data = encoder.encode(text) + tail
                n, start, piece = len(data) // 4, 0, 0
                size = n % capacity or capacity
                while start < n:
                    for column, value in zip(out, (i, piece, start, size, zlib.crc32(data[4 * start : 4 * (start + size)]))):
                        column.append(value)
                    start, piece, size = start + size, piece + 1, capacity
            return out

        return kernel

    made = arrow_map(docs, [F.col("doc_id").cast("bigint").alias("doc_id"), "text"], "doc_id long, piece int, start long, length long, ids_crc32 long", setup)
    return written(made.withColumn("uid", F.monotonically_increasing_id()))


# --- the genetic algorithm on one block ---


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the volume bound, raised for items too large to share a bin."""
    if not len(sizes):
        return 0
    best = -(-int(sizes.sum()) // capacity)
    for k in np.unique(sizes[sizes <= capacity // 2]):
        large = sizes > capacity - k
        middle = (sizes > capacity // 2) & ~large
        small = (sizes >= k) & (sizes <= capacity // 2)
        free = int(middle.sum()) * capacity - int(sizes[middle].sum())
        best = max(best, int(large.sum()) + int(middle.sum()) + max(0, -(-(int(sizes[small].sum()) - free) // capacity)))
    return max(best, int((sizes > capacity // 2).sum()))


@dataclass
class Packing:
    """One individual: the bin of each item, and how full each bin is."""

    where: np.ndarray
    loads: np.ndarray


def best_fit(where: np.ndarray, loads: np.ndarray, loose: np.ndarray, sizes: np.ndarray, capacity: int) -> Packing:
    """Each loose item, in the given order, into the fullest bin that still takes it."""
    order = np.lexsort((np.arange(len(loads)), capacity - loads))
    free = list(zip((capacity - loads[order]).tolist(), order.tolist()))
    placed, made = [], len(loads)
    for size in sizes[loose].tolist():
        at = bisect_left(free, (size, -1))
        if at == len(free):
            n, room = made, capacity
            made += 1
        else:
            room, n = free.pop(at)
        placed.append(n)
        insort(free, (room - size, n))
    where = where.copy()
    where[loose] = placed
    full = np.zeros(made, np.int64)
    for room, n in free:
        full[n] = capacity - room
    return Packing(where, full)


def largest_first(items: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return items[np.lexsort((items, -sizes[items]))]


def decreasing(sizes: np.ndarray, capacity: int) -> Packing:
    """Best fit decreasing: the first individual."""
    return best_fit(np.zeros(len(sizes), np.int64), np.zeros(0, np.int64), largest_first(np.arange(len(sizes)), sizes), sizes, capacity)


def fitness(x: Packing, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then fuller bins, by the sum of squared fills."""
    return len(x.loads), -float(((x.loads / capacity) ** 2).sum())


def crossover(a: Packing, b: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """Well-filled bins of ``b`` injected whole into ``a``; bins of ``a`` that repeat an item go,
    and what they alone held is put back by best fit."""
    pool = np.argsort(-b.loads, kind="stable")[: max(1, len(b.loads) * 2 // 3)]
    chosen = pool[rng.random(len(pool)) < 0.5]
    if not len(chosen):
        chosen = pool[:1]
    new_of_b = np.full(len(b.loads), -1, np.int64)
    new_of_b[chosen] = np.arange(len(chosen))
    injected = new_of_b[b.where]
    taken = injected >= 0
    stays = np.ones(len(a.loads), bool)
    stays[a.where[taken]] = False
    new_of_a = np.where(stays, np.cumsum(stays) - 1 + len(chosen), -1)
    where = np.where(taken, injected, new_of_a[a.where])
    loose = largest_first(np.flatnonzero(where < 0), sizes)
    return best_fit(where, np.concatenate([b.loads[chosen], a.loads[stays]]), loose, sizes, capacity)


def mutate(x: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """The emptiest bins and a few random ones are dissolved; their items are put back in any order."""
    gone = np.zeros(len(x.loads), bool)
    gone[np.argsort(x.loads, kind="stable")[: max(1, len(x.loads) // 50)]] = True
    gone[rng.integers(0, len(x.loads), 3)] = True
    new = np.where(gone, -1, np.cumsum(~gone) - 1)
    where = new[x.where]
    return best_fit(where, x.loads[~gone], rng.permutation(np.flatnonzero(where < 0)), sizes, capacity)


def evolve(sizes: np.ndarray, capacity: int, seed: int, given: list[Packing], population: int = 6, generations: int = 6) -> list[Packing]:
    """Individuals, best first, after a fixed number of generations of any block. The best one is
    never lost, so that nothing is worse than best fit decreasing."""
    rng = np.random.default_rng(seed)
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return [Packing(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    key = lambda x: fitness(x, capacity)
    everyone = list(given) or [decreasing(sizes, capacity)]
    everyone.sort(key=key)
    while len(everyone) < population:
        everyone.append(mutate(everyone[0], sizes, capacity, rng))
    for _ in range(generations):
        everyone.sort(key=key)
        children = []
        for _ in range(population - 1):
            a, b = rng.choice(len(everyone), 2, replace=False)
            child = crossover(everyone[a], everyone[b], sizes, capacity, rng)
            children.append(mutate(child, sizes, capacity, rng) if rng.random() < 0.5 else child)
        everyone = sorted([*everyone, *children], key=key)[:population]
    return everyone


# --- islands as rows ---

STATE = "block long, island int, n_bins int, uids binary, sizes binary, best binary, rest binary"


def as_packing(data: bytes, sizes: np.ndarray) -> Packing:
    """The individual whose bins are these numbers (empty ones are closed up)."""
    _, where = np.unique(np.frombuffer(data, dtype="<i4"), return_inverse=True)
    return Packing(where.astype(np.int64), np.bincount(where, weights=sizes).astype(np.int64))


def evolved(block: int, island: int, uids: np.ndarray, sizes: np.ndarray, capacity: int, seed: int, given: list[Packing]) -> dict:
    people = evolve(sizes, capacity, (seed * 1_000_003 + block * 31 + island) & 0x7FFFFFFF, given)
    packed = [x.where.astype("<i4").tobytes() for x in people[:3]]
    return {"block": block, "island": island, "n_bins": len(people[0].loads), "uids": uids.astype("<i8").tobytes(), "sizes": sizes.astype("<i4").tobytes(), "best": packed[0], "rest": b"".join(packed[1:])}


def pack_blocks(items: DataFrame, blocks: int, capacity: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """uid, bin (unique over blocks), offset, fill for every row of ``items`` (uid, length).

    A group is one block on one island: about ``BLOCK_ITEMS`` rows at any corpus size.
    """
    import pandas as pd

    def first(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid")
        return pd.DataFrame([evolved(int(key[0]), int(key[1]), rows["uid"].to_numpy(), rows["length"].to_numpy(), capacity, seed, [])])

    def later(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                uids, sizes = np.frombuffer(r.uids, "<i8"), np.frombuffer(r.sizes, "<i4")
                own = [as_packing(x, sizes) for x in (r.best, *(r.rest[i : i + 4 * len(uids)] for i in range(0, len(r.rest), 4 * len(uids))), r.migrant)]
                out.append(evolved(r.block, r.island, uids, sizes, capacity, seed + r.epoch, own))
            if out:
                yield pd.DataFrame(out)

    def unpack(batches):
        for rows in batches:
            for r in rows.itertuples():
                uids, sizes, where = np.frombuffer(r.uids, "<i8"), np.frombuffer(r.sizes, "<i4"), np.frombuffer(r.best, "<i4")
                order = np.lexsort((uids, where))
                w, s = where[order], sizes[order].astype(np.int64)
                before = np.cumsum(s) - s
                starts = np.searchsorted(w, w, side="left")
                fill = np.bincount(where, weights=sizes).astype(np.int64)
                yield pd.DataFrame({"uid": uids[order], "bin": (np.int64(r.block) << 24) + w, "offset": before - before[starts], "fill": fill[w]})

    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"))
    one = F.array(*(F.lit(i) for i in range(islands)))
    state = written(dealt.withColumn("island", F.explode(one)).groupBy("block", "island").applyInPandas(first, STATE))
    for epoch in range(1, epochs):
        # The elite of each island goes to the next one.
        migrants = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("best").alias("migrant"))
        state = written(state.join(migrants, ["block", "island"]).withColumn("epoch", F.lit(epoch)).mapInPandas(later, STATE))
    best = state.groupBy("block").agg(F.min_by(F.struct("uids", "sizes", "best"), F.struct("n_bins", "island")).alias("x")).select("block", "x.*")
    return best.mapInPandas(unpack, "uid long, bin long, offset long, fill long")


BLOCK_ITEMS = 2048


def pack(pieces: DataFrame, capacity: int = CAPACITY, islands: int = 2, epochs: int = 3, seed: int = 11, pool_below: float = 0.98) -> DataFrame:
    """``pieces`` (written; with uid and length) with sequence_id and offset added."""
    short = pieces.filter(F.col("length") < capacity).select("uid", "length")
    n = short.count()
    full = pieces.filter(F.col("length") >= capacity).select("*", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not n:
        return full
    placed = written(pack_blocks(short, max(1, round(n / BLOCK_ITEMS)), capacity, islands, epochs, seed))
    # Bins that a block could not fill are pooled over all blocks and packed again.
    poor = placed.filter(F.col("fill") < pool_below * capacity)
    before, m = poor.agg(F.count_distinct("bin"), F.count("*")).first()
    if before > 1:
        pooled = poor.select("uid").join(short, "uid")
        again = written(pack_blocks(pooled, max(1, round(m / BLOCK_ITEMS)), capacity, islands, epochs, seed + 1000).withColumn("bin", F.col("bin") + F.lit(1 << 56)))
        if again.agg(F.count_distinct("bin")).first()[0] < before:
            placed = placed.filter(F.col("fill") >= pool_below * capacity).unionByName(again)
    found = placed.select("uid", F.col("bin").alias("sequence_id"), "offset")
    return pieces.filter(F.col("length") < capacity).join(found, "uid").unionByName(full)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    return pack(cut(docs, capacity, path), capacity).drop("uid")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    out = pack_documents(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
