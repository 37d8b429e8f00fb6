"""Pregel-style graph programs over vertex and edge tables.

A superstep combines messages by target (with partial aggregation), joins them to the vertices,
updates vertex columns by Column expressions, and sends new messages along edges. Vertices and
combined messages are written to the checkpoint folder every step, so plans stay short and lost
executors cost one step. Edges are computed once and written ordered by target: where the vertices
are small enough to be sent to every executor, a step shuffles about one message a vertex, and else
the edges too. The driver sees three numbers a step.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import checkpoint_dir, written

#: Estimated bytes of vertices up to which they are sent to every executor.
SENT_BYTES = 64 << 20
#: Types of a fixed length.
FIXED = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")

#: Message combiners.
COMBINERS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "list": F.collect_list}


@dataclass(frozen=True)
class Step:
    """What an update may use: the combined message (NULL if none), the number of the superstep,
    and the aggregate of the vertices before it."""

    message: Column
    superstep: int
    aggregate: object


def placed(edges: DataFrame) -> DataFrame:
    """The edges written once, those of a target together unless they are too many for one file."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(edges.repartitionByRange(n, "dst", "src"))


def run(
    vertices: DataFrame,
    edges: DataFrame,
    messages: DataFrame,
    update: Callable[[Step], dict[str, Column]],
    send: Column,
    combiner: str | Callable[[Column], Column] = "sum",
    sends: Column | None = None,
    aggregator: Column | None = None,
    max_supersteps: int | None = None,
    until_inactive: bool = False,
) -> DataFrame:
    """Final vertices.

    ``vertices`` have ``id`` and ``active`` and any other columns; ``edges`` have ``src``, ``dst`` and
    any other columns; ``messages`` are (dst, msg). ``update(step)`` gives new columns for the
    vertices that are active or have a message (others stay as they are); ``send`` is the message
    over vertex and edge columns, sent where ``sends`` holds. The program ends when no message is
    left and no vertex is active (``until_inactive``: all vertices send in
    every step, until none is active). Messages to unknown vertices are dropped. There is no limit of
    supersteps unless ``max_supersteps`` gives one; if it is reached before the end, that is an error.
    """
    return _run(vertices, placed(edges), messages, update, send, combiner, sends, aggregator, max_supersteps, until_inactive)


def _run(vertices, edges, messages, update, send, combiner="sum", sends=None, aggregator=None, max_supersteps=None, until_inactive=False) -> DataFrame:
    """``run`` along edges that are placed already."""
    checkpoint_dir(vertices.sparkSession)
    combine = COMBINERS[combiner] if isinstance(combiner, str) else combiner
    combined = lambda mail: mail.groupBy(F.col("dst").alias("__to")).agg(combine(F.col("msg")).alias("__msg"))
    now, inbox = vertices, combined(messages)
    for superstep in itertools.count():
        if superstep == max_supersteps:
            raise RuntimeError(f"after {max_supersteps} supersteps vertices are active or messages under way")
        aggregate = now.agg(aggregator).first()[0] if aggregator is not None else None
        joined = now.join(inbox, F.col("id") == F.col("__to"), "left").drop("__to")
        awake = F.col("active") | F.col("__msg").isNotNull()
        new = update(Step(F.col("__msg"), superstep, aggregate))
        stepped = joined.withColumns({f"__n_{n}": F.when(awake, c).otherwise(F.col(n)) for n, c in new.items()})
        kept = [F.col(f"__n_{c}").alias(c) if c in new else F.col(c) for c in now.columns]
        now = stepped.select(*kept, awake.alias("__awake")).checkpoint()
        left, n = now.agg(F.count_if("active"), F.count("*")).first()
        if until_inactive and not left:
            return now.drop("__awake")
        out = now.filter((F.col("__awake") | F.lit(until_inactive)) & (sends if sends is not None else F.lit(True))).drop("__awake")
        small = all(kind in FIXED for _, kind in out.dtypes) and n * (16 + 8 * len(out.columns)) <= SENT_BYTES
        sent = edges.join(F.broadcast(out) if small else out, out["id"] == edges["src"])
        # Not a checkpoint: that keeps the estimate of the join's size, whose digits would double in every step.
        inbox = written(combined(sent.select(F.col("dst"), send.alias("msg")).filter("msg IS NOT NULL")))
        now = now.drop("__awake")
        if not left and inbox.isEmpty():
            return now


def pagerank(edges: DataFrame, vertices: DataFrame | None = None, damping: float = 0.85, epsilon: float = 1e-3, least_steps: int = 10, most_steps: int = 30) -> DataFrame:
    """id, rank. Each step is (1 - damping) / N plus damping times what arrives; a vertex is
    settled once its change is below ``epsilon`` after ``least_steps``, and all are after
    ``most_steps``. Settled vertices go on sending until all are."""
    edges = placed(edges)
    ids = vertices.select("id") if vertices is not None else edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    start = ids.join(degree, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    checkpoint_dir(edges.sparkSession)
    start = start.checkpoint()
    n = start.count()
    if not n:
        return start.select("id", F.lit(0.0).alias("rank"))
    start = start.select("id", "degree", F.lit(1.0 / n).alias("rank"), F.lit(True).alias("active"))

    def update(step: Step) -> dict[str, Column]:
        rank = F.lit((1 - damping) / n) + damping * F.coalesce(step.message, F.lit(0.0))
        still = F.abs(rank - F.col("rank")) < epsilon if step.superstep >= least_steps else F.lit(False)
        return {"rank": F.lit(1.0 / n) if step.superstep == 0 else rank, "active": F.lit(step.superstep < most_steps) & ~still}

    empty = start.sparkSession.createDataFrame([], f"dst {dict(start.dtypes)['id']}, msg double")
    final = _run(start, edges, empty, update, F.try_divide("rank", "degree"), "sum", until_inactive=True)
    return final.select("id", "rank")


def shortest_paths(edges: DataFrame, source, weight: str | None = None, max_supersteps: int | None = None) -> DataFrame:
    """id, distance (NULL where unreachable) from ``source``, with non-negative weights (else 1)."""
    edges = placed(edges)
    cost = F.col(weight).cast("double") if weight else F.lit(1.0)
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    start = ids.select("id", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("active"), F.lit(False).alias("better"))
    first = start.sparkSession.range(1).select(F.lit(source).cast(dict(start.dtypes)["id"]).alias("dst"), F.lit(0.0).alias("msg"))

    def update(step: Step) -> dict[str, Column]:
        better = F.coalesce(step.message < F.col("distance"), step.message.isNotNull())
        return {"distance": F.when(better, step.message).otherwise(F.col("distance")), "active": F.lit(False), "better": better}

    final = _run(start, edges, first, update, F.col("distance") + cost, "min", F.col("better"), max_supersteps=max_supersteps)
    return final.select("id", "distance")


def connected_components(edges: DataFrame, max_supersteps: int | None = None) -> DataFrame:
    """id, component: the least id that is reachable, directions ignored."""
    both = placed(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    start = both.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("component"), F.lit(True).alias("active"), F.lit(True).alias("better"))

    def update(step: Step) -> dict[str, Column]:
        if step.superstep == 0:
            return {"component": F.col("component"), "active": F.lit(False), "better": F.lit(True)}
        better = F.coalesce(step.message < F.col("component"), F.lit(False))
        return {"component": F.least("component", step.message), "active": F.lit(False), "better": better}

    kind = dict(start.dtypes)["id"]
    empty = start.sparkSession.createDataFrame([], f"dst {kind}, msg {kind}")
    return _run(start, both, empty, update, F.col("component"), "min", F.col("better"), max_supersteps=max_supersteps).select("id", "component")
