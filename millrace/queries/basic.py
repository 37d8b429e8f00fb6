"""Projection, filter, partition-level and sort queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import joins, partitions
from millrace.operators.keyed import flat_map_value, map_value
from millrace.plans.relation import as_table


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("w"))
    return words.filter("w <> ''").groupBy("w").agg(F.count("*").alias("n"))


def map_project(spark, sf_dir):
    return as_table(table(spark, sf_dir, "events")).select("event_id", "upper(event_type) as et", "value * 2 as v2").df


def filter_pred(spark, sf_dir):
    return as_table(table(spark, sf_dir, "events")).where("value > 50", "event_type in ('click', 'view')").select("event_id").df


def grep_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("the"))).select("doc_id")


def map_value_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    return map_value(orders, "v", F.round(F.col("v") * 2, 2))


def flat_map_value_query(spark, sf_dir):
    return flat_map_value(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), "n_name", F.split("n_name", " ")).select("k", F.col("n_name").alias("part"))


def enumerate_idx(spark, sf_dir):
    return partitions.enumerate_rows(table(spark, sf_dir, "events").select("event_id"), [F.col("event_id")])


def batch_100(spark, sf_dir):
    made = partitions.batch(table(spark, sf_dir, "events").select("event_id"), 100, [F.col("event_id")])
    ids = F.transform("rows", lambda r: r["event_id"])
    return made.select(F.col("batch").alias("b"), F.size("rows").cast("bigint").alias("n"), F.array_min(ids).alias("lo"), F.array_max(ids).alias("hi"))


def zip_with(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select("event_id")
    return joins.zip_with(ids.select(F.col("event_id").alias("l")), ids.select(F.col("event_id").alias("r")), [F.col("l")], [F.col("r").desc()])


def error_tolerant_map(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id")
    return partitions.tolerant_map(events, "r", F.try_divide(F.lit(1.0), F.col("event_id") % 100), 0.02).df


def glom_sizes(spark, sf_dir):
    """Each partition's rows: 0 to 399 by fives, 100 in each of four partitions dealt by range."""
    made = partitions.glom(spark.range(0, 2000, 5, 4), "rows")
    return made.select("partition", F.size("rows").cast("bigint").alias("n"), F.array_min(F.transform("rows", lambda r: r["id"])).alias("lo"))


def slice_partitions(spark, sf_dir):
    """The rows of the second and third of four partitions, which hold 1000 numbers each."""
    return partitions.slice_partitions(spark.range(0, 4000, 1, 4), 1, 3)


def merge_split(spark, sf_dir):
    """How many rows each of three merged partitions has; twelve held 100 rows each."""
    merged = partitions.merge_split(spark.range(0, 1200, 1, 12), size=4)
    return partitions.enumerate_partition(merged).groupBy("partition").agg(F.count("*").alias("n"), F.min("id").alias("lo"))


def enumerate_partition(spark, sf_dir):
    """The partition of each number, of ten partitions of ten."""
    return partitions.enumerate_partition(spark.range(0, 100, 1, 10)).select("id", "partition")


def sample_bernoulli(spark, sf_dir):
    return partitions.sample(table(spark, sf_dir, "events").select("event_id"), 0.1)


def pipe_upper(spark, sf_dir):
    return partitions.pipe(table(spark, sf_dir, "nation"), "n_name", "tr a-z A-Z")


def index_by(spark, sf_dir):
    made = as_table(table(spark, sf_dir, "nation")).index_by("n_regionkey")
    return made.select(F.col("key.n_regionkey").alias("k"), F.col("value.n_name").alias("v"))


def sort_rank(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return partitions.enumerate_rows(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], "rk", 1).select("o_orderkey", "rk")


def top_10(spark, sf_dir):
    events = as_table(table(spark, sf_dir, "events").select("event_id", "value"))
    return events.select("event_id", "value", "-event_id as earlier").top(10, "value, earlier").select("event_id", "value").df


def bottom_10(spark, sf_dir):
    return as_table(table(spark, sf_dir, "events").select("event_id", "value")).top(10, "value, event_id", reverse=True).df


def math_fns(spark, sf_dir):
    return as_table(table(spark, sf_dir, "events")).select("event_id", "round(math.sqrt(value), 6) as s", "round(log(value + 1), 6) as l", "int(floor(value)) as f").df


def string_fns(spark, sf_dir):
    return as_table(table(spark, sf_dir, "customer")).select("c_custkey", "c_name.lower() as low", "c_name[:4] as head", "c_name[-3:] as tail", "len(c_name) + 0 as n", "c_mktsegment.replace('B', 'b') as seg").select("c_custkey", "low", "head", "tail", "int(n) as n", "seg").df


def union_all(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return joins.union([a, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))])


def union_uniq(spark, sf_dir):
    return union_all(spark, sf_dir).distinct()


QUERIES = {
    "word_count": word_count, "map_project": map_project, "filter_pred": filter_pred, "grep_lines": grep_lines,
    "map_value": map_value_query, "flat_map_value": flat_map_value_query, "enumerate_idx": enumerate_idx, "batch_100": batch_100,
    "zip_with": zip_with, "error_tolerant_map": error_tolerant_map, "glom_sizes": glom_sizes, "slice_partitions": slice_partitions,
    "merge_split": merge_split, "enumerate_partition": enumerate_partition, "sample_bernoulli": sample_bernoulli, "pipe_upper": pipe_upper,
    "index_by": index_by, "sort_rank": sort_rank, "top_10": top_10, "bottom_10": bottom_10, "math_fns": math_fns, "string_fns": string_fns,
    "union_all": union_all, "union_uniq": union_uniq,
}

SQL = {
    "word_count": r"SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text,'\s+')) AS w FROM documents) WHERE w<>'' GROUP BY w",
    "map_project": "SELECT event_id, upper(event_type) AS et, value*2 AS v2 FROM events",
    "filter_pred": "SELECT event_id FROM events WHERE value>50 AND event_type IN ('click','view')",
    "grep_lines": "SELECT doc_id FROM documents WHERE contains(text,'the')",
    "map_value": "SELECT o_orderkey, round(o_totalprice*2,2) AS v FROM orders",
    "flat_map_value": "SELECT n_nationkey AS k, unnest(string_split(n_name,' ')) AS part FROM nation",
    "enumerate_idx": "SELECT event_id, row_number() OVER (ORDER BY event_id)-1 AS idx FROM events",
    "batch_100": "SELECT b, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id)-1)//100 AS b FROM events) GROUP BY b",
    "zip_with": "SELECT a.event_id AS l, b.event_id AS r FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) i FROM events) a JOIN (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) i FROM events) b USING (i)",
    "error_tolerant_map": "SELECT event_id, CAST(1 AS DOUBLE)/(event_id%100) AS r FROM events WHERE event_id%100<>0",
    "glom_sizes": "SELECT CAST(i AS INTEGER) AS partition, 100 AS n, i * 500 AS lo FROM range(4) t(i)",
    "slice_partitions": "SELECT i AS id FROM range(1000, 3000) t(i)",
    "merge_split": "SELECT CAST(i AS INTEGER) AS partition, 400 AS n, i * 400 AS lo FROM range(3) t(i)",
    "enumerate_partition": "SELECT i AS id, CAST(i // 10 AS INTEGER) AS partition FROM range(100) t(i)",
    "pipe_upper": "SELECT upper(n_name) AS line FROM nation",
    "index_by": "SELECT n_regionkey AS k, n_name AS v FROM nation",
    "sort_rank": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders",
    "top_10": "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10",
    "bottom_10": "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 10",
    "math_fns": "SELECT event_id, round(sqrt(value),6) AS s, round(ln(value+1),6) AS l, CAST(floor(value) AS BIGINT) AS f FROM events",
    "string_fns": "SELECT c_custkey, lower(c_name) AS low, c_name[1:4] AS head, right(c_name,3) AS tail, length(c_name) AS n, replace(c_mktsegment,'B','b') AS seg FROM customer",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_uniq": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
}
