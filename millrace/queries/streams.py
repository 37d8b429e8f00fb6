"""Streaming queries, run to the end of what is there, and graph and example programs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.graph import examples, pregel
from millrace.queries.basic import table
from millrace.storage import scratch
from millrace.streaming import state, windows


def _events(spark, sf_dir):
    """The events as a stream of instants."""
    schema = table(spark, sf_dir, "events").schema
    read = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return windows.with_watermark(read, "ts", "40 days")


def _local(df):
    return df.withColumn("w", F.col("w").cast("timestamp_ntz"))


def stream_tumble(spark, sf_dir):
    made = windows.tumble(_events(spark, sf_dir), "ts", "1 hour", {"n": F.count("*")}, ("event_type",))
    return _local(state.to_end(made, "complete"))


def stream_slide(spark, sf_dir):
    made = windows.count_by_window(_events(spark, sf_dir), "ts", "2 hours", "1 hour")
    return _local(state.to_end(made, "complete"))


def stream_key_window(spark, sf_dir):
    made = windows.aggregate_by_window(_events(spark, sf_dir), "ts", "1 day", {"lo": F.min("value"), "hi": F.max("value")}, ("user_id",))
    return _local(state.to_end(made, "complete"))


def stream_count_zero_fill(spark, sf_dir):
    counts = state.to_end(windows.count_by_window(_events(spark, sf_dir), "ts", "1 hour"), "complete")
    return _local(windows.zero_filled(counts, "1 HOUR"))


def stream_update_state(spark, sf_dir):
    folder = f"{scratch(spark)}/update-{uuid.uuid4().hex}"
    last = []
    update = lambda values, old: F.coalesce(old, F.lit(0).cast("bigint")) + F.size(values)
    writer = state.update_state_by_key(_events(spark, sf_dir), "user_id", "event_id", update, folder, "bigint", "bigint", "bigint", lambda df, n: last.append(n))
    writer.trigger(availableNow=True).start().awaitTermination()
    made = spark.read.schema("k bigint, s bigint").parquet(f"{folder}/state/{last[-1]}")
    return made.select(F.col("k").alias("user_id"), F.col("s").alias("n"))


def stream_union(spark, sf_dir):
    events = _events(spark, sf_dir).select("event_id", "event_type")
    return state.to_end(events.filter("event_id % 2 = 0").unionByName(events.filter("event_id % 3 = 0")))


def stream_transform(spark, sf_dir):
    made = windows.transform(_events(spark, sf_dir), lambda df: df.filter("value > 50").select("event_id", F.upper("event_type").alias("t")))
    return state.to_end(made)


def stream_join(spark, sf_dir):
    events = _events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")
    clicks = events.filter("event_type = 'click'").select(F.col("event_id").alias("c"), "ts", "user_id")
    views = events.filter("event_type = 'view'").select(F.col("event_id").alias("v"), F.col("ts").alias("vts"), "user_id")
    made = windows.stream_join(clicks, views, ["user_id"], "ts", "vts", "1 hour")
    return state.to_end(made.select("user_id", "c", "v"))


# --- graphs: suppliers that share orders ---


def _edges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    a, b = lines.alias("a"), lines.alias("b")
    same = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") + 1 == F.col("b.l_linenumber"))
    pairs = a.join(b, same).select(F.col("a.l_suppkey").alias("src"), F.col("b.l_suppkey").alias("dst"))
    return pairs.filter("src <> dst").distinct()


def sssp(spark, sf_dir):
    return pregel.shortest_paths(_edges(spark, sf_dir), 1).select("id", F.col("distance").cast("bigint").alias("d"))


def components(spark, sf_dir):
    return pregel.connected_components(_edges(spark, sf_dir))


def pagerank(spark, sf_dir):
    """Ranks after exactly thirty steps."""
    ranks = pregel.pagerank(_edges(spark, sf_dir), epsilon=0.0, most_steps=30)
    return ranks.select("id", F.round("rank", 9).alias("rank"))


def cosine_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return examples.cosine_top(vectors.filter("vec_id % 50 = 0"), vectors, 3)


def kmeans(spark, sf_dir):
    return examples.kmeans(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x")), 5)


def logreg(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 2 * 2 - 1).cast("double").alias("y"))
    return examples.logistic_regression(vectors, 10)


QUERIES = {
    "stream_tumble": stream_tumble, "stream_slide": stream_slide, "stream_key_window": stream_key_window, "stream_count_zero_fill": stream_count_zero_fill,
    "stream_update_state": stream_update_state, "stream_union": stream_union, "stream_transform": stream_transform, "stream_join": stream_join,
    "sssp": sssp, "components": components, "pagerank": pagerank, "cosine_topk": cosine_topk, "kmeans": kmeans, "logreg": logreg,
}

_EDGES = "WITH RECURSIVE e AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey=b.l_orderkey AND a.l_linenumber+1=b.l_linenumber WHERE a.l_suppkey<>b.l_suppkey), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"

SQL = {
    "stream_tumble": "SELECT time_bucket(INTERVAL '1 hour', ts) AS w, event_type, count(*) AS n FROM events GROUP BY 1,2",
    "stream_slide": "SELECT w, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS w FROM events) GROUP BY 1",
    "stream_key_window": "SELECT time_bucket(INTERVAL '1 day', ts) AS w, user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1,2",
    "stream_update_state": "SELECT user_id, count(*) AS n FROM events GROUP BY 1",
    "stream_union": "SELECT event_id, event_type FROM events WHERE event_id%2=0 UNION ALL SELECT event_id, event_type FROM events WHERE event_id%3=0",
    "stream_transform": "SELECT event_id, upper(event_type) AS t FROM events WHERE value>50",
    "stream_join": "SELECT a.user_id, a.event_id AS c, b.event_id AS v FROM events a JOIN events b ON a.user_id=b.user_id AND time_bucket(INTERVAL '1 hour', a.ts)=time_bucket(INTERVAL '1 hour', b.ts) WHERE a.event_type='click' AND b.event_type='view'",
    "sssp": _EDGES + ", p(id, d) USING KEY (id) AS (SELECT CAST(1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS d UNION SELECT e.dst, min(p.d)+1 FROM p JOIN e ON e.src=p.id LEFT JOIN recurring.p AS o ON o.id=e.dst WHERE o.d IS NULL OR o.d>p.d+1 GROUP BY e.dst) SELECT v.id, p.d FROM v LEFT JOIN p USING (id)",
    "components": _EDGES + ", u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(id, c) USING KEY (id) AS (SELECT id, id AS c FROM v UNION SELECT u.dst, min(r.c) FROM r JOIN u ON u.src=r.id LEFT JOIN recurring.r AS o ON o.id=u.dst WHERE r.c<o.c GROUP BY u.dst) SELECT id, c AS component FROM r",
    "pagerank": _EDGES + ", n AS (SELECT count(*) AS n FROM v), w AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS k FROM e), r AS (SELECT 0 AS s, id, CAST(1 AS DOUBLE)/n AS rank FROM v, n UNION ALL SELECT m.s+1, v.id, 0.15/n.n+0.85*coalesce(x.t,0) FROM v CROSS JOIN n CROSS JOIN (SELECT max(s) AS s FROM r) m LEFT JOIN (SELECT w.dst, sum(r.rank/w.k) AS t FROM r JOIN w ON w.src=r.id GROUP BY 1) x ON x.dst=v.id WHERE m.s<30) SELECT id, round(rank,9) AS rank FROM r WHERE s=30",
    "stream_count_zero_fill": "WITH c AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS w, count(*) AS n FROM events GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT min(w) FROM c), (SELECT max(w) FROM c), INTERVAL '1 hour')) AS w) SELECT w, coalesce(n,0) AS n FROM s LEFT JOIN c USING (w)",
    "cosine_topk": "SELECT a, b, s FROM (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS rk FROM embeddings a, embeddings b WHERE a.vec_id%50=0 AND a.vec_id<>b.vec_id) WHERE rk<=3",
}
