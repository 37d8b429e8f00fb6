"""Exact line deduplication, native: DataFrame functions only.

Lines become 128-bit hashes of their keys. The hashes are range-partitioned with the document as
a further column, so that a very frequent line is spread over many ranges, and each range is sorted
by hash, then document and position. Streaming over that order, the first line of each document
stays and those that repeat it are passed over; the first occurrences of a hash give the number of
its documents and the largest document, which keeps the line, one row a range and hash before they
are shuffled. Decisions come back as compressed bitmaps, one row a document that loses lines, with
an entry for each word of 64 lines in which a line goes.

Defined cases: a null or empty text is one empty line; ties (one line several times in the keeping
document) all stay there; a null doc_id counts as smaller than any; rows that repeat a doc_id count
as one document when documents are counted, and lose lines alike where their texts are equal; an
empty table gives no rows. Only the id and the text are read (``drop_lines`` keeps all columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import read, small_or_shuffled, written

MIN_LENGTH = 40
MIN_DOCS = 5
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without white space at both ends and with A-Z in lower case. ``lower`` does that
    for ASCII; other lines are translated, since ``lower`` would change more than A-Z there."""
    bare = F.trim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def hashed_lines(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, text_hash, pos, h1, h2 for every line whose key is long enough."""
    split = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line"),
    ).filter(F.length("line") >= min_length)
    keyed = split.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_length)
    return keyed.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def first_occurrences(lines: DataFrame) -> DataFrame:
    """h1, h2, doc_id of the first line of each hash in each document.

    Ranges are by hash and document; rows of one hash and document lie in one range, so numbering
    them in the order of position needs neither another shuffle nor another sort.
    """
    ranged = lines.select("h1", "h2", "doc_id", "pos").repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    run = Window.partitionBy("h1", "h2", "doc_id").orderBy("pos")
    return ranged.withColumn("nth", F.row_number().over(run)).filter("nth = 1").select("h1", "h2", "doc_id")


def repeated(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """h1, h2, keeper for the hashes found in at least ``min_docs`` documents."""
    return (
        first_occurrences(lines)
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )


def keep_bitmaps(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_hash, n_dropped and words: for each word of 64 lines that loses one, its number
    and the bits of the lines that stay. Documents that lose nothing have no row; missing words
    keep all their lines."""
    lines = written(hashed_lines(docs, min_length))
    found = written(repeated(lines, min_docs))
    n = found.count()
    dropped = (
        lines.join(small_or_shuffled(found, n, 24), ["h1", "h2"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .select("doc_id", "text_hash", "pos")
    )
    words = (
        dropped.groupBy("doc_id", "text_hash", F.shiftright("pos", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("gone"))
        .groupBy("doc_id", "text_hash")
        .agg(F.sum(F.bit_count("gone")).alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("keep")))).alias("words"))
    )
    return words


def dense(words: Column) -> Column:
    """Bits of all words up to the last one listed; words that are missing keep all their lines.
    Each entry is preceded by as many full words as it is further than the entry before."""
    before = F.concat(F.array(F.lit(-1)), F.transform(words, lambda x: x["word"]))
    filled = F.zip_with(words, before, lambda x, w: F.when(x.isNull(), F.array().cast("array<bigint>")).otherwise(F.concat(F.array_repeat(F.lit(-1).cast("bigint"), x["word"] - w - 1), F.array(x["keep"]))))
    return F.flatten(filled)


def kept_lines(text: Column, words: Column) -> Column:
    """The lines that the bitmap keeps, joined again; linear in the text and the bitmap."""
    places = F.sequence(F.lit(0), F.lit(63))
    flags = F.flatten(F.transform(dense(words), lambda w: F.transform(places, lambda b: F.getbit(w, b) == 1)))
    # Lines beyond the last word listed have no flag and stay; flags beyond the last line have none.
    stay = F.zip_with(F.split(text, "\n", -1), flags, lambda line, flag: F.when(F.coalesce(flag, F.lit(True)), line))
    return F.array_join(stay, "\n")


def with_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``__mr_words`` and ``__mr_dropped`` (null where nothing is dropped)."""
    bitmaps = written(keep_bitmaps(docs, **options))
    n, words = bitmaps.agg(F.count("*"), F.sum(F.size("words"))).first()
    right = bitmaps.select(F.col("doc_id").alias("__mr_id"), F.col("text_hash").alias("__mr_hash"), F.col("n_dropped").alias("__mr_dropped"), F.col("words").alias("__mr_words"))
    # A bitmap row is an id, a hash and an entry for each word of 64 lines in which one goes.
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__mr_id")) & (F.xxhash64("text") == F.col("__mr_hash"))
    return docs.join(small_or_shuffled(right, 1, 48 * n + 24 * (words or 0)), same, "left")


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the repeated lines; all rows and columns stay."""
    made = with_bitmaps(docs, **options)
    text = F.when(F.col("__mr_words").isNull(), F.col("text")).otherwise(kept_lines(F.col("text"), F.col("__mr_words")))
    return made.withColumn("text", text).select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before, lines dropped and digest of what stays, for every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    made = with_bitmaps(docs)
    kept = F.when(F.col("__mr_words").isNull(), F.col("text")).otherwise(kept_lines(F.col("text"), F.col("__mr_words")))
    return made.select(
        "doc_id",
        (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
        F.coalesce(F.col("__mr_dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
    )


OP7_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
