"""Joins, cogroup and cartesian product.

Strategy is left to Spark unless a hint is asked for; ``broadcast_join`` sends its small side only
if the optimizer's size estimate allows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("inner", "left", "right", "full", "left_semi", "left_anti")


def join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], kind: str = "inner", null_safe: bool = False, hint: str | None = None) -> DataFrame:
    """Equi-join on columns of the same name: keys, the left's rest, the right's rest.

    ``null_safe`` lets NULL keys match each other. ``hint`` may be ``merge`` or ``shuffle_hash``.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    names = [keys] if isinstance(keys, str) else list(keys)
    right = right.hint(hint) if hint else right
    if not null_safe:
        return left.join(right, names, kind)
    renamed = reduce(lambda df, k: df.withColumnRenamed(k, f"__r_{k}"), names, right)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in names])
    marked = renamed.withColumn("__right", F.lit(True)) if kind in ("right", "full") else renamed
    joined = left.join(marked, same, kind)
    if kind in ("left_semi", "left_anti"):
        return joined
    rest = [c for c in [*left.columns, *right.columns] if c not in names]
    key = [F.when(F.col("__right"), F.coalesce(f"__r_{k}", k)).otherwise(F.col(k)).alias(k) if kind in ("right", "full") else F.col(k) for k in names]
    return joined.select(*key, *rest)


def join_pair(left: DataFrame, right: DataFrame, left_key: str, right_key: str, kind: str = "inner") -> DataFrame:
    """Join on columns of different names; both key columns stay."""
    return left.join(right, left[left_key] == right[right_key], kind)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_join(left: DataFrame, small: DataFrame, keys: str | Sequence[str], kind: str = "inner", limit_bytes: int = 256 << 20) -> DataFrame:
    """Join that sends ``small`` to every executor if its estimate is within ``limit_bytes``;
    beyond it both sides are shuffled, with the same result."""
    side = F.broadcast(small) if estimated_bytes(small) <= limit_bytes else small
    return left.join(side, [keys] if isinstance(keys, str) else list(keys), kind)


def semi_by_set(df: DataFrame, key: str, members: DataFrame, member_key: str) -> DataFrame:
    """Rows whose key is in a set of keys."""
    return df.join(members.select(F.col(member_key).alias(key)), key, "left_semi")


def left_join_last(left: DataFrame, right: DataFrame, key: str, sequence: str | Column) -> DataFrame:
    """Left join that keeps at most one match, the last by ``sequence``."""
    rest = [c for c in right.columns if c != key]
    order = F.col(sequence) if isinstance(sequence, str) else sequence
    last = right.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(key, "__last.*")
    return left.join(last, key, "left")


def cogroup(frames: Sequence[DataFrame], key: str, value: str, null_safe: bool = True) -> DataFrame:
    """Full-outer grouping of any number of (key, value) frames: the key and one list column a
    frame (``values_0`` ...), empty where a frame lacks the key.

    All frames are tagged and grouped once: a single shuffle whatever their number.
    """
    tagged = [f.select(F.col(key).alias("__k"), F.col(value).alias("__v"), F.lit(i).alias("__t")) for i, f in enumerate(frames)]
    every = reduce(DataFrame.unionByName, tagged)
    if not null_safe:
        every = every.filter("__k IS NOT NULL")
    lists = [F.coalesce(F.collect_list(F.when(F.col("__t") == i, F.struct(F.col("__v").alias("v")))), F.array()).alias(f"values_{i}") for i in range(len(frames))]
    grouped = every.groupBy("__k").agg(*lists)
    return grouped.select(F.col("__k").alias(key), *[F.transform(f"values_{i}", lambda x: x["v"]).alias(f"values_{i}") for i in range(len(frames))])


def cogroup_udf(left: DataFrame, right: DataFrame, key: str, function, schema: str) -> DataFrame:
    """Escape hatch: an opaque function over the two pandas frames of a key."""
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(function, schema)


def cartesian(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of rows, for users who ask for them."""
    return left.crossJoin(right)


def hot_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """key: those that hold at least this share of the rows; there are at most ``1 / share``."""
    counts = df.groupBy(key).agg(F.count("*").alias("__n"))
    total = df.count()
    return counts.filter((F.col("__n") >= share * total) & F.col(key).isNotNull()).select(key)


def skew_join(left: DataFrame, right: DataFrame, key: str, kind: str = "inner", salts: int = 16, share: float = 0.001) -> DataFrame:
    """Equi-join for a left side in which few keys hold many rows: rows of keys that hold at least
    ``share`` of the left's are salted, and only their rows on the right repeated once a salt. For
    inner and left joins; results equal the plain join's."""
    if kind not in ("inner", "left"):
        raise ValueError("the repeated side may only be looked up")
    # At most 1 / share keys, whatever the input's size.
    hot = F.broadcast(hot_keys(left, key, share).withColumn("__hot", F.lit(True)))
    marked = lambda df: df.join(hot, key, "left")
    salted = marked(left).withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0).cast("int")).drop("__hot")
    every, one = F.sequence(F.lit(0), F.lit(salts - 1)), F.array(F.lit(0))
    spread = marked(right).withColumn("__salt", F.explode(F.when(F.col("__hot"), every).otherwise(one))).drop("__hot")
    return salted.join(spread, [key, "__salt"], kind).drop("__salt")


def zip_with(left: DataFrame, right: DataFrame, left_order: Sequence[Column], right_order: Sequence[Column]) -> DataFrame:
    """Rows paired by position in the given orders, up to the shorter side."""
    from millrace.operators.partitions import enumerate_rows

    a = enumerate_rows(left, left_order, "__i")
    b = enumerate_rows(right, right_order, "__i")
    return a.join(b, "__i").drop("__i")


def union(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union, by column name."""
    if not frames:
        raise ValueError("a union needs a schema: give at least one frame")
    return reduce(DataFrame.unionByName, frames)
