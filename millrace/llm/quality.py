"""Quality classifier: naive Bayes support vectors.

Documents become sets of n-gram indicators. Each indicator is scaled by its class log-count ratio
``log((p / |p|) / (q / |q|))`` (p, q: smoothed counts in the two classes), and a linear hinge-loss
model is fitted on the scaled indicators by dual coordinate descent. A logistic curve fitted on
held-back margins turns margins into scores.

The n-grams are words and pairs of words (in lower case), and word *shapes* (case pattern, digits,
punctuation, repetition) and pairs of them, which carry over to unseen words and other languages;
shares of a shape in its document enter as banded indicators. Indicators that fewer than
``min_docs`` labelled documents have are counted and left out on the executors.

Defined cases: null and empty texts have the single indicator ``empty``; repeated rows are scored
alike; if the labelled rows hold a single class or none, every score is that class's share (0.5
without rows). Columns besides id, text and label are not read.
"""

from __future__ import annotations

import math
import operator
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, held_out, read, written

WORD = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.DOTALL)


@dataclass(frozen=True)
class QualityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    #: The words among the indicators; a pair is one only if both its words are.
    words: frozenset[str] = frozenset()


def shape(word: str) -> str:
    """Case and punctuation pattern of a word, such as ``a``, ``A.``, ``UU!!`` or ``a$$$``."""
    lead, core, tail = WORD.match(word).groups()
    if not core:
        kind = ""
    elif core.isdigit():
        kind = "9"
    elif core.isalpha():
        if core.islower():
            kind = "a"
        elif len(core) == 1:
            kind = "A"
        elif core.isupper():
            kind = "UU"
        else:
            kind = "A" if core[1:].islower() else "aA"
        if len(core) > 24:
            kind += "+"
    else:
        kind = "x"
    return lead[:3] + kind + tail[:3]


class Shapes(dict):
    """Shapes by word; emptied when full, so memory stays bounded (to about 8 MB)."""

    def __missing__(self, word: str) -> str:
        if len(self) > 40_000:
            self.clear()
        found = self[word] = shape(word)
        return found


def band(share: float) -> int:
    """0 for all, 1 for at least half, ... 6 for less than 1/32."""
    return min(6, math.ceil(-math.log2(share)))


def features(text: str | None, shapes: Shapes, known: frozenset[str] | None = None) -> set[str]:
    """Indicators of a whole text; with ``known``, of words and pairs only those of known words."""
    words = text.split() if text else []
    if not words:
        return {"empty"}
    seq = list(map(shapes.__getitem__, words))
    again = list(map(operator.eq, words[1:], words))
    n = len(words)
    out = {f"len:{min(14, n.bit_length())}"}
    counts: dict[str, int] = {}
    for s in seq:
        counts[s] = counts.get(s, 0) + 1
    for s, k in counts.items():
        out.add(f"1:{s}")
        out.add(f"1%:{s}:{band(k / n)}")
    for a, b in set(zip(seq, seq[1:])):
        out.add(f"2:{a} {b}")
    plain = text.lower().split()
    if known is None:
        out.update(plain)
        out.update(map("{} {}".format, plain, plain[1:]))
    else:
        kept = [w if w in known else "" for w in plain]
        out.update(kept)
        out.update([f"{a} {b}" for a, b in zip(kept, kept[1:]) if a and b])
    doubled = sum(again)
    tripled = sum(map(operator.and_, again[1:], again))
    out.add(f"r2:{band(doubled / n) if doubled else 7}")
    out.add(f"r3:{band(tripled / n) if tripled else 7}")
    out.add(f"d:{band(len(set(words)) / n)}")
    return out


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """Weights of the linear hinge-loss model; one dual variable a row, boxed by its cost."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    norm = np.array([float(v @ v) for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            if norm[i] == 0:
                continue
            at, v = rows[i], values[i]
            gradient = y[i] * float(w[at] @ v) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[at] += step * y[i] * v
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def logistic_fit(margin: np.ndarray, label: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by damped Newton steps."""
    a, b = 1.0, 0.0
    target = np.where(label > 0, (np.sum(label > 0) + 1) / (np.sum(label > 0) + 2), 1 / (np.sum(label <= 0) + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = p - target
        h = np.maximum(p * (1 - p), 1e-9)
        ga, gb = float(g @ margin) + 1e-3 * a, float(g.sum())
        haa, hab, hbb = float(h @ (margin * margin)) + 1e-3, float(h @ margin), float(h.sum()) + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = 1 / max(1.0, abs(da), abs(db))
        a, b = a - scale * da, b - scale * db
        if max(abs(da), abs(db)) < 1e-7:
            break
    return max(a, 1e-6), b


def fit_rows(names: list[str], rows: list[np.ndarray], labels: list[int], cost: float = 0.1, epochs: int = 20, smoothing: float = 1.0, folds: int = 4, seed: int = 7) -> QualityModel:
    """Fit on the numbers of each document's indicators (by ``names``) and 0/1 labels."""
    y = np.where(np.array(labels, dtype=int) > 0, 1.0, -1.0) if labels else np.zeros(0)
    if len(set(y.tolist())) < 2:
        return QualityModel(constant=float(np.mean(y > 0)) if len(y) else 0.5)
    size = len(names) + 1

    def train(keep: np.ndarray) -> np.ndarray:
        p, q = np.full(size, smoothing), np.full(size, smoothing)
        for i in np.flatnonzero(keep):
            (p if y[i] > 0 else q)[rows[i]] += 1
        ratio = np.log((p / p.sum()) / (q / q.sum()))
        ratio[-1] = 1.0  # the bias
        at = [np.append(rows[i], size - 1) for i in np.flatnonzero(keep)]
        values = [ratio[a] / math.sqrt(len(a)) for a in at]
        yy = y[keep]
        share = np.mean(yy > 0)
        each = np.where(yy > 0, cost * 0.5 / share, cost * 0.5 / (1 - share)) * 10
        return dual_coordinate_descent(at, values, yy, size, each, epochs, seed) * ratio

    def margin(w: np.ndarray, i: int) -> float:
        return (float(w[rows[i]].sum()) + w[-1]) / math.sqrt(len(rows[i]) + 1)

    part = np.random.default_rng(seed).integers(0, folds, len(y))
    margins = np.zeros(len(y))
    for k in range(folds):
        keep = part != k
        if len(set(y[keep].tolist())) < 2:
            keep = np.ones(len(y), dtype=bool)
        w = train(keep)
        for i in np.flatnonzero(part == k):
            margins[i] = margin(w, i)
    slope, shift = logistic_fit(margins, y)
    w = train(np.ones(len(y), dtype=bool))
    return QualityModel({f: float(x) for f, x in zip(names, w) if x}, float(w[-1]), slope, shift, None, frozenset(f for f in names if " " not in f))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, min_docs: int = 3, **options) -> QualityModel:
    """Fit on at most ``max_docs`` labelled documents, those whose hashed id is least; the bound
    keeps the driver's part alike at any corpus size. Indicators are made and counted on the
    executors; the driver gets the common ones' names and each document's numbers."""
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
        .limit(max_docs)
        .select(F.col("doc_id").alias("chosen_id"), F.col("quality").cast("int").alias("quality"))
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"))

    def setup():
        shapes = Shapes()
        return lambda ids, quality, texts: (ids, quality, [sorted(features(t, shapes)) for t in texts])

    made = written(arrow_map(sample, [F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "text"], "doc_id long, quality int, found array<string>", setup))
    common = made.select(F.explode("found").alias("name")).groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    names = sorted(r["name"] for r in common.select("name").collect())
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def numbering():
        number = {name: i for i, name in enumerate(shared.value)}
        return lambda ids, quality, found: (ids, quality, [np.array(sorted(number[f] for f in x if f in number), "<i4").tobytes() for x in found])

    got = arrow_map(made, ["doc_id", "quality", "found"], "doc_id long, quality int, numbers binary", numbering).collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["numbers"])))
    return fit_rows(names, [np.frombuffer(r["numbers"], "<i4").astype(np.int64) for r in got], [r["quality"] for r in got], **options)


def scorer(model: QualityModel):
    """A function from a text to a score from 0 to 1."""
    shapes, get = Shapes(), model.weights.get

    def score(text: str | None) -> float:
        if model.constant is not None:
            return model.constant
        known = [w for f in features(text, shapes, model.words) if (w := get(f)) is not None]
        margin = (sum(sorted(known)) + model.bias) / math.sqrt(len(known) + 1)
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, model.slope * margin + model.shift))))

    return score


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score for every row. The model's size is bounded by the training bound."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        score = scorer(shared.value)
        return lambda ids, texts: (ids, [score(t) for t in texts])

    return arrow_map(docs, [F.col("doc_id").cast("bigint").alias("doc_id"), "text"], "doc_id long, score double", setup)


def op5_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels that are not held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out("doc_id")))
    return score_documents(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
