"""Language identification by compression.

Each language gets a raw-content zstandard dictionary of whole labelled texts. A text is cut into
blocks, each block is compressed once with every dictionary, and the language whose dictionary
gives the fewest bytes in all wins. A narrow margin between the best two is rejected.

Defined cases: a null text, an empty text and a text without any letter give ``und`` with score 0;
ties go to the language with more sampled documents, then the alphabetically first; repeated rows are scored alike; with no labelled
rows every text is ``und``. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, held_out, read, small_or_shuffled, written

#: A text has a letter if this matches.
LETTER = re.compile(r"[^\W\d_]")
SPACES = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class LanguageModel:
    """Languages, the most sampled first, and a dictionary's bytes for each."""

    langs: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    level: int = 9
    block_bytes: int = 4096
    min_margin: float = 0.01


def normalized(text: str) -> bytes:
    """Lower-cased words joined by single spaces, as UTF-8, so that case, digits and punctuation
    do not tell languages apart."""
    return SPACES.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def fit(docs: DataFrame, docs_per_lang: int = 48, **options) -> LanguageModel:
    """Make dictionaries of a bounded sample of ``docs`` (doc_id, text, lang).

    The sample is, for each language, the ``docs_per_lang`` documents whose hashed id is least,
    with repeated texts taken once; they are used whole. A count by language first gives the hash
    below which about twice as many lie, so that ranking sees a bounded number of rows however
    many documents a language has.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Uniform from 0 to 1; a part of the documents lies below each share of it.
    rank = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)) / float(1 << 40)
    rows = known.select("doc_id", "lang", rank.alias("rank"))
    shares = written(rows.groupBy("lang").agg(((2 * docs_per_lang + 64) / F.count("*")).alias("share")))
    order = Window.partitionBy("lang").orderBy("rank", "doc_id")
    chosen = (
        rows.join(small_or_shuffled(shares, shares.count(), 64), "lang")
        .filter("rank < share")
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= docs_per_lang)
        .select(F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_lang"), "rank")
    )
    # At most docs_per_lang rows a language: bounded by the parameter, not by the data.
    sample = (
        known.join(F.broadcast(chosen), F.expr("doc_id <=> chosen_id AND lang = chosen_lang"))
        .select("lang", "rank", "text")
        .dropDuplicates(["lang", "text"])
        .orderBy("lang", "rank", "text")
        .collect()
    )
    parts: dict[str, list[bytes]] = {}
    for row in sample:
        parts.setdefault(row["lang"], []).append(normalized(row["text"]))
    langs = tuple(sorted(parts, key=lambda x: (-len(parts[x]), x)))
    return LanguageModel(langs, tuple(b" ".join(parts[x]) for x in langs), **options)


def classifier(model: LanguageModel):
    """A function from a text to (language, score, rejected)."""
    import zstandard

    makers = []
    for data in model.dictionaries:
        content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=model.level)
        makers.append(zstandard.ZstdCompressor(level=model.level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    step, langs, margin = model.block_bytes, model.langs, model.min_margin

    def classify(text: str | None) -> tuple[str, float, bool]:
        if not text or not langs or not LETTER.search(text):
            return "und", 0.0, True
        data = normalized(text)
        blocks = [data] if len(data) <= step else [data[i : i + step] for i in range(0, len(data), step)]
        sizes = [sum(len(make(b)) for b in blocks) for make in makers]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best] + 2)
        gap = (second - sizes[best]) / max(1, second)
        return langs[best], gap / (gap + 0.02), gap < margin

    return classify


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang (the guess), accepted (false if the margin is narrow), score, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        classify = classifier(shared.value)

        def kernel(ids, texts):
            found = [classify(t) for t in texts]
            return ids, [x[0] for x in found], [not x[2] for x in found], [x[1] for x in found]

        return kernel

    return arrow_map(docs, [F.col("doc_id").cast("bigint").alias("doc_id"), "text"], "doc_id long, lang string, accepted boolean, score double", setup)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out("doc_id")))
    return identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), F.col("lang").alias("lang_pred"), "score", "accepted")
