"""Chroma audio fingerprints of a media column.

A recording (WAV bytes, 16-bit PCM) becomes a sequence of frames of energy in twelve pitch classes.
Filters of six shapes are evaluated on that image through its integral image; each gives two bits,
and sixteen of them a packed 32-bit integer for every frame.

Two recordings are aligned by an offset histogram: every pair of equal bits of two codes votes for
the offset between them, so that an offset's votes and the codes that it covers give its bit error,
and the offset of least bit error is the alignment. Histograms are exact and cover all pairs and
all offsets of ``MIN_OVERLAP`` codes or more: voting with single bits is a correlation, which is
computed for many recordings at once through Fourier transforms.

Equal fingerprints are one class, searched once. Classes are dealt into parts of bounded size; in
one shuffle each part meets the queries, which stream by, and a task returns a part's best match
for a query.

Defined cases: a null, malformed or too short recording has no codes, no class and no match;
silence has codes like any sound; ties go to the smaller id; repeated rows are one class; an empty
table gives no rows. Columns besides id and audio are not read.
"""

from __future__ import annotations

import io
import wave
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, read, small_or_shuffled, written

FRAME, HOP = 512, 160
#: Frames that the widest filter spans.
SPAN = 16
#: Recordings that a task holds, and queries that it works on at once.
PART, QUERIES = 2048, 1024
#: Codes that an alignment covers at least (or all of the shorter recording).
MIN_OVERLAP = 2 * SPAN
#: Values of spectra held at a time, and of histograms (about what a cache takes).
AT_ONCE, HISTOGRAMS = 1 << 22, 1 << 21


def filters() -> list[tuple[int, int, int, int]]:
    """Sixteen filters by rule: shape, first pitch class, pitch classes, frames."""
    return [(k % 6, (5 * k) % 9, 3 + k % 2 if k % 6 != 4 else 3, SPAN if k % 3 == 0 else SPAN // (1 + k % 3)) for k in range(16)]


def samples(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples from -1 to 1 and their rate; none for what is not 16-bit PCM."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0), 1
            raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float64) / 32768
            n = w.getnchannels()
            return raw[: len(raw) // n * n].reshape(-1, n).mean(1), w.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0), 1


@lru_cache(8)
def pitch_classes(rate: int) -> np.ndarray:
    """Weights from spectrum bins to the twelve pitch classes."""
    frequency = np.arange(FRAME // 2 + 1) * rate / FRAME
    weights = np.zeros((FRAME // 2 + 1, 12))
    for i, f in enumerate(frequency):
        if 60 <= f <= 4000:
            weights[i, int(round(12 * np.log2(f / 440))) % 12] = 1
    return weights


def chroma(signal: np.ndarray, rate: int) -> np.ndarray:
    """Energy by frame and pitch class, smoothed over frames; each frame has unit length."""
    if len(signal) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2 @ pitch_classes(rate)
    kernel = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
    padded = np.pad(power, ((2, 2), (0, 0)), mode="edge")
    smooth = sum(k * padded[i : i + len(power)] for i, k in enumerate(kernel))
    norm = np.sqrt((smooth**2).sum(1, keepdims=True))
    return np.divide(smooth, norm, out=np.zeros_like(smooth), where=norm > 1e-9)


def codes(image: np.ndarray) -> np.ndarray:
    """A packed integer for each place where the widest filter fits."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(image) + 1, 13))
    integral[1:, 1:] = image.cumsum(0).cumsum(1)

    def area(t: int, y: int, w: int, h: int) -> np.ndarray:
        a, b = slice(t, t + n), slice(t + w, t + w + n)
        return integral[b, y + h] - integral[a, y + h] - integral[b, y] + integral[a, y]

    out = np.zeros(n, np.uint32)
    for k, (kind, y, h, w) in enumerate(filters()):
        whole = area(0, y, w, h)
        if kind == 0:  # area against the rest
            plus, minus = whole, area(0, 0, w, 12) - whole
        elif kind == 1:  # upper against lower pitches
            plus, minus = area(0, y + h // 2, w, h - h // 2), area(0, y, w, h // 2)
        elif kind == 2:  # later against earlier
            plus, minus = area(w // 2, y, w - w // 2, h), area(0, y, w // 2, h)
        elif kind == 3:  # diagonal quarters
            plus = area(0, y, w // 2, h // 2) + area(w // 2, y + h // 2, w - w // 2, h - h // 2)
            minus = whole - plus
        elif kind == 4:  # middle pitch against its neighbours
            plus = area(0, y + h // 3, w, h // 3)
            minus = whole - plus
        else:  # middle third of the time against the others
            plus = area(w // 3, y, w // 3, h)
            minus = whole - plus
        value = np.log1p(np.maximum(plus, 0)) - np.log1p(np.maximum(minus, 0))
        level = np.digitize(value, (-0.35, 0.0, 0.35))
        gray = level ^ (level >> 1)
        out |= gray.astype(np.uint32) << np.uint32(2 * k)
    return out


def fingerprint(data: bytes | None) -> np.ndarray:
    signal, rate = samples(data)
    return codes(chroma(signal, rate))


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """Share of differing bits where ``a[i + offset]`` lies over ``b[i]``."""
    lo, hi = max(0, -offset), min(len(b), len(a) - offset)
    if hi <= lo:
        return 1.0
    return float(np.bitwise_count(a[lo + offset : hi + offset] ^ b[lo:hi]).sum()) / (32 * (hi - lo))


def fingerprints(media: DataFrame, key: str = "rec_id", audio: str = "audio") -> DataFrame:
    """rec_id and codes (little-endian 32-bit integers; null if none) for every row."""

    def setup():
        return lambda ids, data: (ids, [x.astype("<u4").tobytes() if len(x := fingerprint(d)) else None for d in data])

    return arrow_map(media, [F.col(key).cast("bigint").alias("rec_id"), audio], "rec_id long, codes binary", setup)


def spectra(prints: list[np.ndarray], length: int) -> np.ndarray:
    """Transforms of the bits (as 1 and -1) over time: frequency, recording, bit."""
    signs = np.zeros((length, len(prints), 32), np.float32)
    for k, p in enumerate(prints):
        signs[: len(p), k] = (p[:, None] >> np.arange(32, dtype=np.uint32) & 1).astype(np.float32) * 2 - 1
    return np.fft.rfft(signs, axis=0)


def rounded_up(n: int) -> int:
    """The least even number from ``n`` on that has no other prime factors than 2, 3 and 5."""
    n += n % 2
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 2


class Align:
    """The best match so far for each of a block of queries."""

    def __init__(self, ids: list[int], prints: list[bytes]):
        self.ids = np.array(ids, np.int64)
        self.prints = [np.frombuffer(p, "<u4") for p in prints]
        self.lengths = np.array([len(p) for p in self.prints])
        self.best: dict[int, tuple[float, int, int, int]] = {}
        self.least = np.full(len(ids), np.inf)
        self.kept: dict = {}

    def add(self, rec_ids: list[int], data: list[bytes]) -> None:
        """Compare with these recordings at all offsets."""
        others = [np.frombuffer(d, "<u4") for d in data]
        cases: dict[int, list[list[int]]] = {}
        for side, prints in enumerate((self.prints, others)):
            for i, p in enumerate(prints):
                cases.setdefault(len(p).bit_length(), [[], []])[side].append(i)
        sizes = np.array([len(p) for p in others])
        for queries, _ in cases.values():
            for _, recs in cases.values():
                if not queries or not recs:
                    continue
                # Offsets that cover too little may run into each other; all others do not.
                asked_sizes, rec_sizes = self.lengths[queries], sizes[recs]
                least = min(MIN_OVERLAP, int(asked_sizes.min()), int(rec_sizes.min()))
                length = rounded_up(int(asked_sizes.max() + rec_sizes.max()) - least)
                most = max(1, AT_ONCE // (16 * length))
                for q in range(0, len(queries), most):
                    asked = queries[q : q + most]
                    there = self.transformed(asked, length)
                    some = max(1, HISTOGRAMS // (length * len(asked)))
                    for r in range(0, len(recs), some):
                        part = recs[r : r + some]
                        self.judge(np.array(asked), there, np.array([rec_ids[i] for i in part]), [others[i] for i in part], length)

    def transformed(self, asked: list[int], length: int) -> np.ndarray:
        """Transforms of some queries; the last ones are kept for the next recordings."""
        key = (asked[0], asked[-1], len(asked), length)
        if key not in self.kept:
            self.kept = {key: np.conj(spectra([self.prints[i] for i in asked], length)).transpose(0, 2, 1).copy()}
        return self.kept[key]

    def judge(self, asked: np.ndarray, there: np.ndarray, rec_ids: np.ndarray, others: list[np.ndarray], length: int) -> None:
        # Votes for less votes against each offset (negative ones last), by recording and query.
        agree = np.fft.irfft(np.matmul(spectra(others, length), there), length, axis=0)
        size, own = np.unique(self.lengths[asked]), np.unique([len(p) for p in others])
        if len(size) > 1 or len(own) > 1:
            size, own = self.lengths[asked], np.array([len(p) for p in others])
        low = np.minimum(size[None, :], own[:, None])
        # The last offsets are the negative ones that any of the queries can have.
        offset = np.arange(length)
        offset[length - int(size.max()) + min(MIN_OVERLAP, int(low.min())) :] -= length
        covered = np.minimum(size[None, None, :], own[None, :, None] - offset[:, None, None]) - np.maximum(0, -offset)[:, None, None]
        enough = covered >= np.minimum(MIN_OVERLAP, low)
        agree *= np.where(enough, 1 / (64.0 * np.maximum(covered, 1)), 0).astype(np.float32)
        if enough.shape[1:] == (1, 1):
            agree[~enough[:, 0, 0]] = -1
        else:
            agree += np.where(enough, 0, -1).astype(np.float32)
        top = agree.max(0)
        top[rec_ids[:, None] == self.ids[asked][None, :]] = -1
        # What may be best within rounding is judged by exact counts.
        limit = np.maximum(0.5 - self.least[asked] - 1e-5, top.max(0) - 2e-5)
        for r, k in zip(*(x.tolist() for x in np.nonzero((top >= limit) & (top > -0.75)))):
            q = int(asked[k])
            a, b = others[r], self.prints[q]
            for shift in offset[agree[:, r, k] >= top[r, k] - 1e-5].tolist():
                lo, hi = max(0, -shift), min(len(b), len(a) - shift)
                found = (bit_error(a, b, shift), int(rec_ids[r]), shift, int((a[lo + shift : hi + shift] == b[lo:hi]).sum()))
                if q not in self.best or found < self.best[q]:
                    self.best[q], self.least[q] = found, found[0]


MATCH = "query_class long, bit_error double, match_class long, match_offset int, votes long"


def part_matches(batches):
    """Kernel over rows (part, asked, class_id, codes) sorted by part and asked: recordings come
    before the queries that stream by."""
    types = [pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.int64()]
    part, ids, data = None, [], []
    for batch in batches:
        parts, asked = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (asked[1:] != asked[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if a == b:
                continue
            if parts[a] != part:
                part, ids, data = parts[a], [], []
            if not asked[a]:
                ids += batch.column(2).slice(a, b - a).to_pylist()
                data += batch.column(3).slice(a, b - a).to_pylist()
                continue
            for at in range(a, b, QUERIES):
                n = min(QUERIES, b - at)
                state = Align(batch.column(2).slice(at, n).to_pylist(), batch.column(3).slice(at, n).to_pylist())
                state.add(ids, data)
                rows = [(int(state.ids[q]), *x) for q, x in sorted(state.best.items())]
                columns = list(zip(*((q, error, match, shift, votes) for q, error, match, shift, votes in rows))) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["query_class", "bit_error", "match_class", "match_offset", "votes"])


def best_matches(classes: DataFrame, queries: DataFrame) -> DataFrame:
    """query_class, match_class, bit_error, match_offset, votes: for each row of ``queries`` (of the
    same columns class_id, codes) the class of least bit error over all offsets, and how many
    codes are equal there (votes)."""
    parts = max(1, -(-classes.count() // PART))
    there = classes.select(F.pmod(F.xxhash64("class_id"), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("asked"), "class_id", "codes")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("asked"), "class_id", "codes")
    dealt = there.unionByName(asked).repartition("part").sortWithinPartitions("part", "asked")
    found = dealt.mapInArrow(part_matches, MATCH)
    return found.groupBy("query_class").agg(F.min(F.struct("bit_error", "match_class", "match_offset", "votes")).alias("x")).select("query_class", "x.*")


def align(media: DataFrame, is_query, key: str = "rec_id", audio: str = "audio") -> DataFrame:
    """One row a recording: rec_id, n_codes, codes, class_id (the smallest id with equal codes), and
    for queries (``is_query(rec_id)``) match_id, bit_error, match_offset, votes. A query whose class
    has other members matches the smallest of them, without bit errors."""
    each = written(fingerprints(media, key, audio).withColumn("h", F.xxhash64("codes")))
    asked = is_query(F.col("rec_id"))
    classes = written(
        each.filter("codes IS NOT NULL")
        .groupBy("h", "codes")
        .agg(F.min("rec_id").alias("class_id"), F.max("rec_id").alias("last_id"), F.max(F.coalesce(asked, F.lit(False))).alias("asked"))
        .filter("class_id IS NOT NULL")
    )
    n, size = classes.agg(F.count("*"), F.sum(F.octet_length("codes"))).first()
    by_codes = classes.select("h", "codes", "class_id", (F.col("last_id") > F.col("class_id")).alias("twins"))
    rows = written(each.join(small_or_shuffled(by_codes, n, 64 + (size or 0) // max(1, n)), ["h", "codes"], "left").select("rec_id", "codes", "class_id", "twins"))
    # The smallest member beside the first, after partial aggregation.
    second = rows.filter("twins AND rec_id <> class_id").groupBy("class_id").agg(F.min("rec_id").alias("second_id"))
    found = best_matches(classes.select("class_id", "codes"), classes.filter("asked AND last_id = class_id").select("class_id", "codes"))
    both = written(second.join(found, second["class_id"] == found["query_class"], "full").select(F.coalesce("class_id", "query_class").alias("known_class"), "second_id", *(c.split()[0] for c in MATCH.split(", ")[1:])))
    rows = rows.join(small_or_shuffled(both, both.count(), 64), (F.col("class_id") == F.col("known_class")) & asked, "left")
    twin = asked & F.col("twins")
    return rows.select(
        "rec_id",
        F.coalesce(F.octet_length("codes") / 4, F.lit(0)).cast("int").alias("n_codes"),
        "codes",
        "class_id",
        F.when(twin, F.when(F.col("rec_id") == F.col("class_id"), F.col("second_id")).otherwise(F.col("class_id"))).otherwise(F.col("match_class")).alias("match_id"),
        F.when(twin, F.lit(0.0)).otherwise(F.col("bit_error")).alias("bit_error"),
        F.when(twin, F.lit(0)).otherwise(F.col("match_offset")).alias("match_offset"),
        F.col("votes"),
    )


# --- recordings made from vectors, since the tables hold no audio ---

RATE, NOTE = 4000, 333


@lru_cache(1)
def notes() -> np.ndarray:
    """A short tone with one overtone for each of 25 semitones up from middle C."""
    t = np.arange(NOTE) / RATE
    f = 261.63 * 2 ** (np.arange(25) / 12)
    tone = np.sin(2 * np.pi * f[:, None] * t) + 0.3 * np.sin(4 * np.pi * f[:, None] * t)
    return np.round(9000 * tone * np.hanning(NOTE) ** 0.25).astype("<i2")


def sonified(vector: list[float] | None) -> bytes | None:
    """WAV bytes of a melody: one note a component, higher for larger components."""
    if not vector:
        return None
    x = np.array(vector, dtype=np.float64)
    top = np.abs(x).max()
    pitch = np.round(12 + 12 * x / top).astype(int)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes(notes()[pitch].tobytes())
    return out.getvalue()


def sonified_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id and audio for every row of the vectors (audio is null for unusable vectors)."""
    table = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("rec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    checked = table.select("rec_id", F.when(F.coalesce(fine, F.lit(False)), F.col("embedding")).alias("embedding"))
    return arrow_map(checked, ["rec_id", "embedding"], "rec_id long, audio binary", lambda: lambda ids, vectors: (ids, [sonified(v) for v in vectors]))


def op2_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all recordings (melodies of the vectors) and, for every id divisible by 50,
    the best aligned other recording."""
    out = align(sonified_table(spark, sf_dir), lambda c: c % 50 == 0)
    return out.select("rec_id", "n_codes", F.crc32("codes").alias("codes_crc32"), "class_id", "match_id", "bit_error", "match_offset", "votes")
