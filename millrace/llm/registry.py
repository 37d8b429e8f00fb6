"""Queries of the training-data operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from millrace.llm.ann import op3_rotated_codes
from millrace.llm.bpe import op10_byte_bpe
from millrace.llm.chroma import op2_chroma_fingerprints
from millrace.llm.language_id import op1_language_id
from millrace.llm.line_dedup import OP7_SQL, op7_line_dedup
from millrace.llm.packing import op4_best_fit_packing
from millrace.llm.pii import op6_pii
from millrace.llm.quality import op5_quality_nbsvm
from millrace.llm.simhash import op9_simhash_golay
from millrace.llm.suffix_dedup import op8_suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_chroma_fingerprints": op2_chroma_fingerprints,
        "op3_rotated_codes": op3_rotated_codes,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_quality_nbsvm": op5_quality_nbsvm,
        "op6_pii": op6_pii,
        "op7_line_dedup": op7_line_dedup,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_simhash_golay": op9_simhash_golay,
        "op10_byte_bpe": op10_byte_bpe,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    own = {"op7_line_dedup": OP7_SQL}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
