"""All queries of the library and their DuckDB equivalents, merged from the family modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.queries import aggregates, basic, formats, more, sql_queries, streams

Query = Callable[[SparkSession, str], DataFrame]
FAMILIES = (basic, aggregates, sql_queries, formats, streams, more)


def queries() -> dict[str, Query]:
    return {name: query for family in FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for family in FAMILIES for name, text in family.SQL.items()}
