"""Keyed aggregation, top-k and upsert over DataFrames.

Keys and values are column names or Columns; aggregates are Columns, so partial aggregation and
code generation stay with Spark. Opaque functions are accepted only where the name says ``_udf``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of a key that a fold with ``combine`` gathers at once.
CHUNK = 4096

Keys = str | Column | Sequence[str | Column]

#: Named reductions: the associative functions that a keyed reduction usually gets.
REDUCERS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "avg": F.avg,
    "first": F.first,
    "last": F.last,
    "list": F.collect_list,
    "set": F.collect_set,
    "and": F.bool_and,
    "or": F.bool_or,
    "product": F.product,
}


def as_columns(keys: Keys) -> list[Column]:
    listed = [keys] if isinstance(keys, (str, Column)) else list(keys)
    return [F.col(k) if isinstance(k, str) else k for k in listed]


def reduce_by_key(df: DataFrame, keys: Keys, value: str | Column, how: str | Callable[[Column], Column], name: str = "value") -> DataFrame:
    """One row a key with its values reduced by a named aggregate or an aggregate function."""
    reducer = REDUCERS[how] if isinstance(how, str) else how
    return df.groupBy(*as_columns(keys)).agg(reducer(as_columns(value)[0]).alias(name))


def combine_by_key(df: DataFrame, keys: Keys, *aggregates: Column) -> DataFrame:
    """Any aggregates by key; NULL inputs are skipped, as a missing combiner is."""
    return df.groupBy(*as_columns(keys)).agg(*aggregates)


def fold_by_key(df: DataFrame, keys: Keys, value: str | Column, zero: Column, merge: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None, order: Keys | None = None, name: str = "value", combine: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """A custom fold, written as Column functions. Values are folded in ``order`` (a sequence
    column) if given, so that functions which do not commute are deterministic.

    ``combine`` joins two results of ``merge``, for folds that may begin anywhere with ``zero``:
    then runs of at most ``CHUNK`` values are folded first, and no list of all of a key's values
    is made.
    """
    v = as_columns(value)[0]
    columns = as_columns(keys)

    def ordered(made: Column, *by: Column) -> Column:
        if not by:
            return F.collect_list(made)
        pairs = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)], made.alias("v"))))
        return F.transform(pairs, lambda p: p["v"])

    by = as_columns(order) if order is not None else []
    if combine is None:
        values = ordered(v, *by)
        folded = F.aggregate(values, zero, merge, finish) if finish else F.aggregate(values, zero, merge)
        return df.groupBy(*columns).agg(folded.alias(name))
    names = [f"__k{i}" for i in range(len(columns))]
    plain = df.select(*[c.alias(n) for n, c in zip(names, columns)], v.alias("__v"), *[c.alias(f"__o{i}") for i, c in enumerate(by)])
    sequence = [F.col(f"__o{i}") for i in range(len(by))]
    if by:
        # Numbers in the order, so that a chunk is a run of it and chunks have an order too.
        from millrace.operators.partitions import enumerate_rows

        plain = enumerate_rows(plain, sequence, "__i")
    else:
        plain = plain.withColumn("__i", F.monotonically_increasing_id())
    chunks = plain.groupBy(*names, F.floor(F.col("__i") / CHUNK).alias("__c")).agg(F.aggregate(ordered(F.col("__v"), *([F.col("__i")] if by else [])), zero, merge).alias("__f"))
    parts = ordered(F.col("__f"), *([F.col("__c")] if by else []))
    total = F.aggregate(parts, zero, combine, finish) if finish else F.aggregate(parts, zero, combine)
    made = chunks.groupBy(*names).agg(total.alias(name))
    titles = df.select(*columns).columns
    return made.select(*[F.col(n).alias(t) for n, t in zip(names, titles)], name)


def group_by_key(df: DataFrame, keys: Keys, value: str | Column = "*", order: Keys | None = None, name: str = "values") -> DataFrame:
    """One row a key with the list of its values (whole rows for ``*``), in ``order`` if given."""
    v = F.struct("*") if isinstance(value, str) and value == "*" else as_columns(value)[0]
    if order is None:
        listed = F.collect_list(v)
    else:
        pairs = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(as_columns(order))], v.alias("v"))))
        listed = F.transform(pairs, lambda p: p["v"])
    return df.groupBy(*as_columns(keys)).agg(listed.alias(name))


def aggregate_by_key_udf(df: DataFrame, keys: Sequence[str], function, schema: str) -> DataFrame:
    """Escape hatch: an opaque function from a key's pandas frame to a pandas frame. A key's rows
    meet in one task; prefer a Column aggregate."""
    return df.groupBy(*keys).applyInPandas(function, schema)


def uniq(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows, or distinct values of some columns."""
    return df.select(*columns).distinct() if columns else df.distinct()


def hot(df: DataFrame, keys: Keys, n: int = 10, name: str = "n") -> DataFrame:
    """The ``n`` most frequent keys with exact counts, most frequent first, ties by key."""
    columns = as_columns(keys)
    counted = df.groupBy(*columns).agg(F.count("*").alias(name))
    return counted.orderBy(F.col(name).desc(), *[F.col(c).asc_nulls_last() for c in counted.columns if c != name]).limit(n)


def hot_approx(df: DataFrame, column: str, n: int = 20, tracked: int = 10_000) -> DataFrame:
    """item, count of about the ``n`` heaviest hitters, from a mergeable sketch of fixed size."""
    return df.selectExpr(f"explode(approx_top_k(`{column}`, {n}, {max(tracked, n)})) AS x").selectExpr("x.item", "x.count")


def top_by_key(df: DataFrame, keys: Keys, order: Keys, n: int, reverse: bool = False, ties: Keys = (), rank: str = "rk") -> DataFrame:
    """Rows of the ``n`` smallest (``reverse``: largest) of each key with their rank.

    Ties go to the smaller ``ties`` columns (the input sequence). A rank limit is pushed below the
    shuffle, so each task sends at most ``n`` rows a key, however frequent the key.
    """
    direction = (lambda c: c.desc_nulls_last()) if reverse else (lambda c: c.asc_nulls_first())
    window = Window.partitionBy(*as_columns(keys)).orderBy(*[direction(c) for c in as_columns(order)], *[c.asc() for c in as_columns(ties)])
    return df.withColumn(rank, F.row_number().over(window).cast("bigint")).filter(F.col(rank) <= n)


def top_lists_by_key(df: DataFrame, key: str, value: str, n: int, reverse: bool = False, ties: Keys = (), name: str = "top") -> DataFrame:
    """One row a key with the list of its ``n`` smallest (largest) values, best first."""
    best = top_by_key(df, key, value, n, reverse, ties, "__rk")
    return best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rk", F.col(value).alias("v")))), lambda x: x["v"]).alias(name))


def upsert(old: DataFrame, new: DataFrame, key: str, value: str, replace_only: bool = False) -> DataFrame:
    """Keyed update: the new value wins, NULL included; ``replace_only`` drops keys that the old
    side does not have."""
    o = old.select(F.col(key).alias("__ok"), F.col(value).alias("__ov"))
    n = new.select(F.col(key).alias("__nk"), F.col(value).alias("__nv"), F.lit(True).alias("__new"))
    joined = o.join(n, F.col("__ok") == F.col("__nk"), "left" if replace_only else "full")
    return joined.select(F.coalesce("__ok", "__nk").alias(key), F.when(F.col("__new"), F.col("__nv")).otherwise(F.col("__ov")).alias(value))


def salted_aggregate(df: DataFrame, keys: Sequence[str], partial: dict[str, Column], final: dict[str, Column], salts: int = 32) -> DataFrame:
    """Two-step aggregation for skewed keys whose partial results are large (lists, sketches):
    by key and salt first, then by key. ``final`` refers to the names in ``partial``."""
    first = df.withColumn("__salt", (F.rand(17) * salts).cast("int")).groupBy(*keys, "__salt").agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()])


def partition_by_key(df: DataFrame, keys: Keys, n: int | None = None) -> DataFrame:
    """Rows of a key in one partition."""
    return df.repartition(n, *as_columns(keys)) if n else df.repartition(*as_columns(keys))


def lookup(df: DataFrame, key: str, wanted, value: str):
    """First value of a key, or None. The filter reaches the scan."""
    row = df.filter(F.col(key).eqNullSafe(F.lit(wanted))).select(value).head()
    return row[0] if row else None


def map_value(df: DataFrame, value: str, expression: Column) -> DataFrame:
    """Replace the value column; the key's partitioning stays."""
    return df.withColumn(value, expression)


def flat_map_value(df: DataFrame, value: str, array: Column) -> DataFrame:
    """One row for each element of an array made from the value."""
    return df.withColumn(value, F.explode(array))


def flat_map_udtf(df: DataFrame, function, *columns: str) -> DataFrame:
    """Each row beside the rows that a table function makes of some of its columns; the rows that
    it makes none of go."""
    return df.lateralJoin(function(*[F.col(c).outer() for c in columns]))
