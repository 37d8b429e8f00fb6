"""Near-duplicate documents by SimHash, at a Jaccard similarity of word shingles.

A fingerprint is a SimHash over a text's distinct shingles, longer than that of ``simhash``: 64-bit
words, each from hashes of its own. Its first word is the document's node. Nodes that differ in at
most three bits are linked by ``simhash.links``, that is by equal segments and Golay keys, without
loss. Texts that share four fifths of their shingles differ in about ten bits of 64, so further
keys reach beyond that: each word gives four keys of 14 bits, no bit is in two of them, and two
rows of one key are linked if at most ``FAR`` of that word's and the next one's 128 bits differ.
A bit is equal with a probability of about 0.848 at 0.8 (least: 0.8125, five shingles against four
of them; exact binomials), so 128 keys have none in common for 1 to 3 pairs in a million, fewer
above; texts of at most ``SHORT`` shingles, where ties of bits cost more, have 256.

Components of these links are only candidates. All pairs within one are compared, on 128 bits of
their fingerprints in blocks, and those that are not connected yet and agree in ``LIKELY`` or more
of the bits are verified on the exact shingle sets; a component's verified pairs, as a forest, make
the classes.

Every member of a component stays a partner for later ones: only members that are already connected
are not compared, since a link between them would change no class.

Defined cases: null and blank texts are copies of each other; texts with fewer words than a
shingle are one shingle; rows with equal words are one class; a null doc_id counts as larger than
any; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.common import arrow_map, small_or_shuffled, written
from millrace.llm.components import components, forest

WORDS, SIMILARITY = 5, 0.8
#: Words of a fingerprint; of one of at most ``SHORT`` shingles.
LENGTH, LONGER, SHORT = 32, 64, 40
#: Keys of a word, and bits of a key.
SHARES, BITS = 4, 14
#: Bits that may differ, of 128, between two rows of one key.
FAR = 28
#: Words that are compared within a component.
SIGN = 2
#: Share of equal bits from which a pair is verified (about 0.85 at 0.8, 0.5 by chance).
LIKELY = 0.6
#: Candidates of one document from which they are verified all at once.
MANY = 16
#: Members of a component, and rows of a key, that one task takes at once.
GROUP, KEY_GROUP = 1024, 4096
#: One node in so many is counted to find the keys that are larger.
SAMPLE = 16


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles (lower-cased A-Z, white space normalised)."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(1, np.uint64)
    k = min(words, len(parts))
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64))


def multipliers(words: int = LENGTH) -> np.ndarray:
    """One for each word; the first words are the same for every number of them."""
    return np.random.default_rng(99).integers(1, 1 << 63, words, dtype=np.uint64) | np.uint64(1)


def majority_bits(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The SimHash bits (0 or 1), 64 for each multiplier: 1 where more than half of the hashes have
    it, after mixing with that multiplier; in blocks, so memory stays bounded."""
    ones = np.zeros(64 * len(odd), np.int64)
    for i in range(0, len(hashes), 255):
        mixed = hashes[i : i + 255]
        mixed = (mixed ^ (mixed >> np.uint64(29)))[:, None] * odd[None, :]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return (2 * ones > len(hashes)).astype(np.uint8)


def signature(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The bits that are compared within a component, each as a whole word of ones or of zeros."""
    return np.uint64(0) - majority_bits(hashes, odd[:SIGN]).astype(np.uint64)


def fingerprint(hashes: np.ndarray, odd: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """The SimHash in 64-bit words: ``LENGTH`` of them, or ``LONGER`` for few shingles."""
    return np.packbits(majority_bits(hashes, longer if len(hashes) <= SHORT else odd)).view(np.uint64)


def key_rows(batches):
    """Rows (node, print) to rows (key, node, own, next): each key with its word and the next."""
    mask = np.uint64((1 << BITS) - 1)
    for batch in batches:
        nodes, prints = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        sizes = np.array([len(x) // 8 for x in prints])
        for first, last in ((0, LENGTH), (LENGTH, LONGER)):
            rows = np.flatnonzero(sizes >= last)
            if not len(rows):
                continue
            words = np.stack([np.frombuffer(prints[i], np.uint64)[first:last] for i in rows.tolist()])
            node, after = nodes[rows], np.roll(words, -1, axis=1)
            for w in range(last - first):
                own = words[:, w]
                for share in range(SHARES):
                    key = np.int64((first + w) * SHARES + share) << BITS | (own >> np.uint64(BITS * share) & mask).astype(np.int64)
                    columns = [pa.array(key), pa.array(node), pa.array(own.view(np.int64)), pa.array(after[:, w].view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "own", "next"])


def near_rows(group: np.ndarray, node: np.ndarray, own: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest over all pairs of rows of one group that differ in at most ``FAR`` bits; rows are
    sorted by group. Each round compares rows one place further apart."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    found: list = []
    step, at = 1, np.flatnonzero(group[1:] == group[:-1])
    while len(at):
        far = np.bitwise_count(own[at] ^ own[at + step]) + np.bitwise_count(after[at] ^ after[at + step])
        hit = at[far <= FAR]
        hit = hit[node[hit] != node[hit + step]]
        if len(hit):
            found.append((node[hit], node[hit + step]))
        step += 1
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if found and (not len(at) or sum(len(x[0]) for x in found) > 1 << 18):
            a, b = forest(np.concatenate([a, *(x[0] for x in found)]), np.concatenate([b, *(x[1] for x in found)]))
            found = []
    return a, b


def links_in_order(batches):
    """Kernel over rows (group, node, own, next) sorted by group, which may span batches."""

    def closed(columns):
        a, b = near_rows(columns[0], columns[1], columns[2].view(np.uint64), columns[3].view(np.uint64))
        return [pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])] if len(a) else []

    held: list = []
    rows = 0
    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in range(4)])
        rows += batch.num_rows
        if rows >= 1 << 16:
            columns = [np.concatenate(x) for x in zip(*held)]
            before = np.flatnonzero(columns[0] != columns[0][-1])
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                yield from closed([x[:cut] for x in columns])
            held, rows = [[x[cut:] for x in columns]], len(columns[0]) - cut
    if rows:
        yield from closed([np.concatenate(x) for x in zip(*held)])


def candidate_links(prints: DataFrame) -> DataFrame:
    """a, b: links between the nodes of ``prints`` (node, print), which are written."""
    schema = "key long, node long, own long, next long"
    counted = prints.filter(F.pmod(F.xxhash64("print"), F.lit(SAMPLE)) == 0).mapInArrow(key_rows, schema).groupBy("key").count()
    parts = F.ceil(F.col("count") * SAMPLE / KEY_GROUP).cast("int").alias("parts")
    crowded = written(counted.filter(F.col("count") * SAMPLE > KEY_GROUP).select("key", parts))
    rows, group = prints.mapInArrow(key_rows, schema), F.shiftleft("key", 24)
    if n := crowded.count():
        # A large key is dealt into parts, and every pair of parts meets in one task.
        rows = rows.join(small_or_shuffled(crowded, n, 12), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own, other = F.pmod(F.xxhash64("node", "next"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        rows = rows.withColumn("i", own).withColumn("j", other)
        group = group + F.least("i", "j") * F.col("parts") + F.greatest("i", "j")
    dealt = rows.select(group.alias("group"), "node", "own", "next").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(links_in_order, "a long, b long").unionByName(simhash.links(prints.select(F.col("node").alias("fp")).distinct()))


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2 (hash of the words) and text."""
    plain = F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    lowered = F.when(F.octet_length(plain) == F.length(plain), F.lower(plain)).otherwise(F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", lowered.alias("plain"))
    return base.select("doc_id", F.xxhash64("plain").alias("t1"), F.xxhash64(F.lit(1), "plain").alias("t2"), "text")


def jaccard(p: np.ndarray, q: np.ndarray) -> float:
    """Of two sorted sets."""
    both = np.concatenate([p, q])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(p) + len(q) - shared)


class Group:
    """Shingle sets of one group's members, with exact similarities of one of them to the others."""

    def __init__(self, sets: list[bytes]):
        self.sets = [np.frombuffer(x, "<u8") for x in sets]
        self.lengths = np.array([len(x) for x in self.sets])
        self.tokens: np.ndarray | None = None

    def similarities(self, x: int, others: np.ndarray) -> np.ndarray:
        own = self.sets[x]
        if len(others) < MANY:
            return np.array([jaccard(own, self.sets[y]) for y in others.tolist()])
        if self.tokens is None:
            tokens = np.concatenate(self.sets)
            order = np.argsort(tokens, kind="stable")
            self.tokens, self.owners = tokens[order], np.repeat(np.arange(len(self.sets)), self.lengths)[order]
        lo, hi = np.searchsorted(self.tokens, own, "left"), np.searchsorted(self.tokens, own, "right")
        shared = np.zeros(len(self.sets), np.int64)
        for i in range(0, len(own), 512):  # in blocks, so memory stays bounded
            count = hi[i : i + 512] - lo[i : i + 512]
            at = np.repeat(lo[i : i + 512] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            shared += np.bincount(self.owners[at], minlength=len(self.sets))
        return shared[others] / (len(own) + self.lengths[others] - shared[others])


def group_forest(ids: list[int], signs: np.ndarray, sets: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Verified pairs that connect one group's members."""
    n, group, out = len(ids), Group(sets), []
    # Component of each member: its first member.
    label = np.arange(n)
    for x in range(1, n):
        firsts = np.flatnonzero(label[:x] == np.arange(x))
        # First members come first: a link to one of them settles its whole component.
        for known in (firsts, None):
            rest = known if known is not None else np.flatnonzero(label[:x] != label[x])
            if known is None:
                rest = rest[label[rest] != rest]
            if not len(rest):
                continue
            share = (signs[rest] == signs[x]).mean(1)
            near = rest[share >= LIKELY]
            if not len(near):
                continue
            for y in near[group.similarities(x, near) >= similarity - 1e-9].tolist():
                if label[x] != label[y]:
                    low, high = sorted((int(label[x]), int(label[y])))
                    label[label == high] = low
                    out.append((ids[x], ids[y]))
    return out


def forests_in_order(similarity: float):
    """Kernel over rows (key, part, uid, sign, hashes) sorted by key and part; ``sign`` is packed."""

    def batch_of(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([max(x) for x in found], pa.int64()), pa.array([min(x) for x in found], pa.int64())], names=["a", "b"])

    def closed(held: list) -> list:
        held.sort(key=lambda x: x[0])
        if len(held) < 2:
            return []
        signs = np.unpackbits(np.array([np.frombuffer(x[1], np.uint8) for x in held]), axis=1)
        return group_forest([x[0] for x in held], signs, [x[2] for x in held], similarity)

    def run(batches):
        held: list = []
        now = None
        for batch in batches:
            found: list = []
            for k, p, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (k, p) != now:
                    found += closed(held)
                    held, now = [], (k, p)
                held.append(row)
            if found:
                yield batch_of(found)
        if found := closed(held):
            yield batch_of(found)

    return run


def near_classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """t1, t2, class_id, n, first_id: for each distinct sequence of words its near-duplicate class
    (the number of one of its members), how many rows have it, and their smallest doc_id."""
    rows = texts_of(docs)
    # One row a distinct text; uid numbers them once they are written.
    distinct = written(rows.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).withColumn("uid", F.monotonically_increasing_id()))

    def setup():
        odd, longer = multipliers(), multipliers(LONGER)

        def kernel(t1, t2, texts):
            prints = [fingerprint(shingle_hashes(t, words), odd, longer) for t in texts]
            return t1, t2, [int(x[0].view(np.int64)) for x in prints], [x.tobytes() for x in prints]

        return kernel

    made = written(arrow_map(rows, ["t1", "t2", "text"], "t1 long, t2 long, node long, print binary", setup))
    # Copies of a text give equal rows; one is kept after a partial aggregation.
    signed = written(made.groupBy("t1", "t2").agg(F.first("node").alias("node"), F.first("print").alias("print")).join(distinct, ["t1", "t2"]).select("uid", "node", "print"))
    roots = written(components(candidate_links(signed.select("node", "print"))))
    placed_by = small_or_shuffled(roots, roots.count(), 16)
    keyed = written(signed.join(placed_by, signed["node"] == roots["node"], "left").select("uid", F.coalesce("root", signed["node"]).alias("key"), F.substring("print", 1, 8 * SIGN).alias("sign")))
    crowded = written(keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key", F.ceil(F.col("m") / GROUP).cast("int").alias("parts")))
    grouped = written(keyed.join(small_or_shuffled(crowded, crowded.count(), 12), "key"))
    members = written(grouped.select("uid").join(distinct.select("uid", "t1", "t2"), "uid"))
    texts = rows.join(small_or_shuffled(members, members.count(), 24), ["t1", "t2"]).select("uid", "text")

    def hashing():
        return lambda uid, text: (uid, [shingle_hashes(t, words).astype("<u8").tobytes() for t in text])

    sets = arrow_map(texts, ["uid", "text"], "uid long, hashes binary", hashing).groupBy("uid").agg(F.first("hashes").alias("hashes"))
    full = written(sets.join(grouped.select("uid", "sign"), "uid"))
    # A large component is dealt into parts, and every pair of parts meets in one task.
    own = F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = grouped.withColumn("own", own).withColumn("other", other).select("key", (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).alias("part"), "uid")
    placed = dealt.join(full, "uid").select("key", "part", "uid", "sign", "hashes").repartition("key", "part").sortWithinPartitions("key", "part")
    roots = components(placed.mapInArrow(forests_in_order(similarity), "a long, b long"))
    named = distinct.join(roots, distinct["uid"] == roots["node"], "left")
    return written(named.select("t1", "t2", F.coalesce("root", "uid").alias("class_id"), "n", "first_id"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, that of the smallest doc_id; all columns
    stay."""
    found = near_classes(docs, words, similarity)
    best = found.groupBy("class_id").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "t1", "t2")).alias("x")).select("x.first_id", "x.t1", "x.t2")
    keep = written(best.select(F.col("first_id").alias("__mr_id"), F.col("t1").alias("__mr_t1"), F.col("t2").alias("__mr_t2")))
    hashes = texts_of(docs.select("doc_id", "text"))
    repeats = not hashes.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    plain = F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    lowered = F.when(F.octet_length(plain) == F.length(plain), F.lower(plain)).otherwise(F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    marked = docs.withColumns({"__mr_h1": F.xxhash64(lowered), "__mr_h2": F.xxhash64(F.lit(1), lowered)})
    same = (F.col("__mr_h1") == F.col("__mr_t1")) & (F.col("__mr_h2") == F.col("__mr_t2")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("__mr_id"))
    kept = marked.join(small_or_shuffled(keep, keep.count(), 24), same, "left_semi")
    if repeats:  # rows that are equal in id and words: one of them
        kept = kept.dropDuplicates(["doc_id", "__mr_h1", "__mr_h2"])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
