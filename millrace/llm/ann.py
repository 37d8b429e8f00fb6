"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector's residual to its nearest centroid is made a unit vector, padded to the code's length and
rotated at random; its code is the packed signs. Two correction scalars, the residual's length and
the inner product of the code with what it stands for, turn the code's inner product with a query
into an estimate without bias, with a bound on its error. Queries are rounded to eight bits, so
that the inner product with packed bits is a sum of population counts. A vector is compared exactly
only if the lower bound of its distance does not exceed the k-th distance known.

Centroids come from a bounded sample; every row is indexed, in groups by centroid that are dealt
into parts of bounded size. A query first probes the nearest centroids that hold k vectors. The
k-th distance found there decides which other centroids it must probe: all whose vectors can be as
near by the centroid's radius. Both probes are one shuffle by group, in which a task holds one
part's codes and lets the queries stream by; nothing is sent from or to the driver but the model.

Defined cases: vectors that are null, zero, or hold null or non-finite components and rows with a
null id take no part; vectors are compared with those of their own dimension, each dimension having
its own model; ties go to the smaller id; the query's own id is never found; of queries that repeat
an id the least vector is asked, and candidates that repeat an id are found each; with fewer
candidates than k all are found; an empty table gives no rows. Columns besides id and vector are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import read, written

#: Least length of a code in bits; longer codes of short vectors have smaller errors.
CODE_BITS = 256
#: Codes that one task holds at once.
PART = 8192
#: Bits to which a rotated query is rounded.
QUERY_BITS = 8
#: Pairs estimated at once.
PAIRS = 1 << 20


@dataclass(frozen=True)
class Coder:
    """Rotation and centroids of one dimension, and the number of its first centroid."""

    rotation: np.ndarray
    centroids: np.ndarray
    first: int

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids."""
        return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ self.centroids.T + (self.centroids**2).sum(1)[None, :])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Centroid number, packed signs (64-bit words), length of the residual, and the code's
        inner product with the rotated unit residual."""
        near = self.gaps(x).argmin(1)
        residual = x - self.centroids[near]
        length = np.sqrt((residual * residual).sum(1))
        unit = np.divide(residual, length[:, None], out=np.zeros_like(residual), where=length[:, None] > 0) @ self.rotation.T
        inner = np.abs(unit).sum(1) / np.sqrt(unit.shape[1])
        return near, packed(unit > 0), length, np.where(inner > 0, inner, 1.0)


def packed(bits: np.ndarray) -> np.ndarray:
    """The last axis (a multiple of 64 long) as 64-bit words."""
    return np.packbits(bits, axis=-1).view(np.uint64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists("embedding", lambda x: x != 0))


def fit(vectors: DataFrame, sample_rows: int = 4096, n_centroids: int = 64, rounds: int = 8, seed: int = 5) -> dict[int, Coder]:
    """A coder for each dimension: a random rotation, and k-means centroids of a sample of about
    ``sample_rows`` rows by hashed id."""
    sizes = {r["d"]: r["n"] for r in vectors.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    out: dict[int, Coder] = {}
    first = 0
    for d, n in sorted(sizes.items()):
        rank = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) / float(1 << 40)
        rows = vectors.filter((F.size("embedding") == d) & (rank <= sample_rows / n)).orderBy(rank, "vec_id").limit(2 * sample_rows).collect()
        if not rows:
            rows = vectors.filter(F.size("embedding") == d).limit(sample_rows).collect()
        x = np.array([r["embedding"] for r in rows])
        bits = max(CODE_BITS, -(-d // 64) * 64)
        rng = np.random.default_rng(seed)
        rotation, triangle = np.linalg.qr(rng.standard_normal((bits, d)))
        centroids = x[rng.choice(len(x), min(n_centroids, max(1, len(x) // 16)), replace=False)]
        for _ in range(rounds):
            near = Coder(rotation, centroids, 0).gaps(x).argmin(1)
            centroids = np.array([x[near == k].mean(0) if (near == k).any() else c for k, c in enumerate(centroids)])
        out[d] = Coder(rotation * np.sign(np.diag(triangle)), centroids, first)
        first += len(centroids)
    return out


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def by_dimension(batch: pa.RecordBatch, at: int):
    """The parts of a batch whose vectors (column ``at``) have one dimension, with it."""
    sizes = np.diff(batch.column(at).offsets.to_numpy())
    for d in np.unique(sizes).tolist():
        yield d, batch.take(pa.array(np.flatnonzero(sizes == d)))


INDEX = "centroid int, vec_id long, code binary, length double, inner double, embedding array<double>"


def build_index(vectors: DataFrame, coders: dict[int, Coder]) -> DataFrame:
    """Written: ``INDEX`` for every row."""
    shared = vectors.sparkSession.sparkContext.broadcast(coders)

    def run(batches):
        for batch in batches:
            for d, b in by_dimension(batch, 1) if batch.num_rows else ():
                coder = shared.value[d]
                near, code, length, inner = coder.encode(matrix(b.column(1), d))
                centroid = pa.array((near + coder.first).astype(np.int32))
                words = pa.array([row.tobytes() for row in code], pa.binary())
                yield pa.RecordBatch.from_arrays([centroid, b.column(0), words, pa.array(length), pa.array(inner), b.column(1)], names=["centroid", "vec_id", "code", "length", "inner", "embedding"])

    return written(vectors.mapInArrow(run, INDEX))


def bounds(coder: Coder, centroid: int, codes: np.ndarray, length: np.ndarray, inner: np.ndarray, queries: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated squared distances of one centroid's codes to the queries, and their lower bounds."""
    turned = (queries - coder.centroids[centroid]) @ coder.rotation.T
    bits = turned.shape[1]
    far = np.sqrt((turned * turned).sum(1))
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / ((1 << QUERY_BITS) - 1), 1e-300)
    rounded = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint16)
    total = np.zeros((len(codes), len(queries)))
    for j in range(QUERY_BITS):
        plane = packed((rounded >> j & 1).astype(bool))
        for w in range(codes.shape[1]):
            total += np.bitwise_count(codes[:, w, None] & plane[None, :, w]) * float(1 << j)
    ones = np.bitwise_count(codes).sum(1).astype(np.float64)
    product = (2 * (total * step + ones[:, None] * low) - (rounded * step[:, None] + low[:, None]).sum(1)) / np.sqrt(bits)
    estimate = length[:, None] ** 2 + far**2 - 2 * length[:, None] * product / inner[:, None]
    # The code's error is that of its part at right angles; rounding a query adds about a step.
    slack = far[None, :] * (epsilon * np.sqrt(np.maximum(0, 1 - inner**2) / max(1, bits - 1)))[:, None] + step[None, :]
    return estimate, estimate - 2 * length[:, None] * slack / inner[:, None]


def probe(coder: Coder, centroid: int, ids: np.ndarray, codes: np.ndarray, length: np.ndarray, inner: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, k: int, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query number, place and distance of the pairs that may be among a query's k nearest (at most
    k a query, and none beyond its limit), and how many pairs were compared exactly."""
    estimate, lower = bounds(coder, centroid, codes, length, inner, queries, epsilon)
    own = ids[:, None] == query_ids[None, :]
    lower[own] = np.inf
    estimate[own] = np.inf
    compared = np.zeros(lower.shape, bool)
    near = limits.copy()
    open_ended = np.flatnonzero(np.isinf(limits))
    if len(open_ended):
        # The most promising ones give a first limit.
        most = min(2 * k, len(ids))
        first = np.argpartition(estimate[:, open_ended], most - 1, axis=0)[:most]
        gap = np.sqrt(((x[first] - queries[open_ended][None]) ** 2).sum(2))
        gap[np.isinf(np.take_along_axis(estimate[:, open_ended], first, 0))] = np.inf
        if most >= k:
            near[open_ended] = np.partition(gap, k - 1, axis=0)[k - 1]
        compared[first, open_ended[None, :]] = True
    place, who = np.nonzero((compared | (lower <= near[None, :] ** 2 * (1 + 1e-9))) & ~own)
    score = np.empty(len(place))
    for i in range(0, len(place), PAIRS // 16):
        at = slice(i, i + PAIRS // 16)
        score[at] = np.sqrt(((x[place[at]] - queries[who[at]]) ** 2).sum(1))
    within = score <= near[who]
    place, who, score, n = place[within], who[within], score[within], len(place)
    order = np.lexsort((ids[place], score, who))
    place, who, score = place[order], who[order], score[order]
    nth = np.arange(len(who)) - np.searchsorted(who, who, side="left")
    best = nth < k
    return who[best], place[best], score[best], n


#: Codes before the queries that stream by them.
TAGGED = "centroid int, part int, asked boolean, vec_id long, code binary, length double, inner double, embedding array<double>"


def probed(index: DataFrame, queries: DataFrame, parts: DataFrame, coders: dict[int, Coder], k: int, epsilon: float) -> DataFrame:
    """query_id, vec_id, score: candidates from each part of the centroids that ``queries``
    (centroid, vec_id, embedding, limit) name."""
    shared = index.sparkSession.sparkContext.broadcast(coders)
    # A row a centroid, and the number of centroids is bounded by the sample.
    small = F.broadcast(parts.select("centroid", "parts"))
    codes = index.join(small, "centroid").select("centroid", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asked"), "vec_id", "code", "length", "inner", "embedding")
    everywhere = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    asked = queries.join(small, "centroid").select("centroid", everywhere, F.lit(True).alias("asked"), "vec_id", F.lit(None).cast("binary").alias("code"), F.col("limit").alias("length"), F.lit(None).cast("double").alias("inner"), "embedding")
    dealt = codes.unionByName(asked).repartition("centroid", "part").sortWithinPartitions("centroid", "part", "asked")

    def run(batches):
        held: list[pa.RecordBatch] = []
        group, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int32)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows, now = batch.slice(a, b - a), tuple(keys[a, :2].tolist())
                if now != group:
                    held, group, block = [], now, None
                if not keys[a, 2]:
                    held.append(rows)
                    continue
                if not held:
                    continue
                if block is None:
                    t = pa.Table.from_batches(held).combine_chunks()
                    column = lambda n: t.column(n).chunk(0)  # noqa: E731,B023
                    d = len(column(7)[0])
                    block = (d, column(3).to_numpy(), np.frombuffer(b"".join(column(4).to_pylist()), np.uint64).reshape(len(t), -1), column(5).to_numpy(), column(6).to_numpy(), matrix(column(7), d))
                d, ids, words, length, inner, x = block
                coder, most = shared.value[d], max(1, PAIRS // len(ids))
                for at in range(0, rows.num_rows, most):
                    some = rows.slice(at, most)
                    query_ids = some.column(3).to_numpy()
                    who, place, score, _ = probe(coder, now[0] - coder.first, ids, words, length, inner, x, query_ids, matrix(some.column(7), d), some.column(5).to_numpy(), k, epsilon)
                    if len(who):
                        yield pa.RecordBatch.from_arrays([pa.array(query_ids[who]), pa.array(ids[place]), pa.array(score)], names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(index: DataFrame, queries: DataFrame, coders: dict[int, Coder], k: int = 10, epsilon: float = 3.0) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row of ``queries`` (vec_id,
    embedding)."""
    parts = written(index.groupBy("centroid").agg(F.count("*").alias("n"), F.max("length").alias("radius")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))
    # Bounded by the number of centroids.
    groups = {r["centroid"]: (r["n"], r["radius"]) for r in parts.collect()}
    shared = index.sparkSession.sparkContext.broadcast((coders, groups))

    def routed(later: bool):
        def run(batches):
            models, sizes = shared.value
            for batch in batches:
                for d, b in by_dimension(batch, 1) if batch.num_rows and models else ():
                    if d not in models:
                        continue
                    coder, x = models[d], matrix(b.column(1), d)
                    count, radius = (np.array([sizes.get(coder.first + c, (0, 0.0))[i] for c in range(len(coder.centroids))]) for i in (0, 1))
                    gap = np.sqrt(coder.gaps(x))
                    order = np.argsort(gap, axis=1, kind="stable")
                    # The nearest centroids that hold k vectors besides the query's own.
                    before = np.cumsum(count[order], axis=1) - count[order]
                    first = np.zeros(gap.shape, bool)
                    np.put_along_axis(first, order, before <= k, axis=1)
                    limit = b.column(2).to_numpy() if later else np.full(len(x), np.inf)
                    chosen = first if not later else ~first & (gap - radius <= limit[:, None] * (1 + 1e-9))
                    row, c = np.nonzero(chosen & (count > 0))
                    taken = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array((c + coder.first).astype(np.int32)), b.column(0).take(taken), b.column(1).take(taken), pa.array(limit[row])], names=["centroid", "vec_id", "embedding", "limit"])

        return run

    schema = "centroid int, vec_id long, embedding array<double>, limit double"
    asked = written(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    near = written(nearest(probed(index, asked.mapInArrow(routed(False), schema), parts, coders, k, epsilon), k))
    limits = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("limit"))
    again = asked.join(limits, asked["vec_id"] == limits["query_id"], "left").select("vec_id", "embedding", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    far = probed(index, again.mapInArrow(routed(True), schema), parts, coders, k, epsilon)
    return nearest(near.select("query_id", "vec_id", "score").unionByName(far), k)


def op3_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of every row whose id is divisible by 100."""
    vectors = usable(read(spark, sf_dir, "embeddings"))
    coders = fit(vectors)
    return search(build_index(vectors, coders), vectors.filter(F.col("vec_id") % 100 == 0), coders)
