"""Corpus pipeline: quality filter, line dedup, near-dedup, masking of personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's documents. All stages but the last return the columns of documents, so
what a stage drops or changes is what the next one sees. Counted as part of ``millrace.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import line_dedup, near_dup, packing, pii, quality
from millrace.llm.common import attach, held_out, read, written

#: Documents that score below are rejected.
LEAST_QUALITY = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (fitted on the labels that are not held out) keeps."""
    labels = read(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    shared = spark.sparkContext.broadcast(quality.fit(docs, labels))

    def setup():
        score = quality.scorer(shared.value)
        return lambda texts: ([score(t) for t in texts],)

    scored = attach(docs, "text", "__mr_quality", "score double", setup)
    return scored.filter(F.col("__mr_quality.score") >= LEAST_QUALITY).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many of them share."""
    return line_dedup.drop_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: candidates by SimHash fingerprints, verified
    on five-word shingles, 0.8 or more."""
    return near_dup.drop_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]

#: No stage but the line dedup can be said in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
