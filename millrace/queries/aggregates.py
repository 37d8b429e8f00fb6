"""Aggregation, top-k by key, sketch and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import joins, keyed, sketches
from millrace.plans.relation import as_table
from millrace.queries.basic import table


def reduce_by_key(spark, sf_dir):
    cents = table(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"))
    return keyed.reduce_by_key(cents, "l_orderkey", "c", "sum", "cents")


def combine_by_key(spark, sf_dir):
    return keyed.combine_by_key(table(spark, sf_dir, "events"), "event_type", F.count("*").alias("n"), F.min("value").alias("lo"))


def fold_by_key(spark, sf_dir):
    made = keyed.fold_by_key(table(spark, sf_dir, "events"), "event_type", F.col("user_id"), F.lit(0).cast("bigint"), lambda a, v: a + v, None, "event_id", "s")
    return made


def group_by_key(spark, sf_dir):
    made = keyed.group_by_key(table(spark, sf_dir, "events"), "user_id", "event_id", order="event_id", name="ids")
    return made.select("user_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def uniq(spark, sf_dir):
    return keyed.uniq(table(spark, sf_dir, "events"), "user_id", "event_type")


def hot_10(spark, sf_dir):
    return keyed.hot(table(spark, sf_dir, "events"), "user_id", 10)


def atop_counts(spark, sf_dir):
    """Each heavy hitter with its count, from the sketch (which tracks more values than there are)."""
    return keyed.hot_approx(table(spark, sf_dir, "events"), "event_type", 20).select(F.col("item").alias("event_type"), F.col("count").alias("n"))


def global_agg(spark, sf_dir):
    return as_table(table(spark, sf_dir, "events")).select_one(n="count(*)", lo="min(value)", hi="max(value)", s="sum(event_id)").df


def adcount_error(spark, sf_dir):
    """The exact number of distinct values, and whether the approximate one is within 5 % of it."""
    lines = table(spark, sf_dir, "lineitem")
    exact = lines.select("l_partkey").distinct().agg(F.count("*").alias("n"))
    return sketches.adcount(lines, "l_partkey", 0.01).select(F.col("n").alias("a")).crossJoin(exact).select("n", (F.abs(F.col("a") - F.col("n")) <= 0.05 * F.col("n")).alias("near"))


def adcount_by_key_error(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    exact = lines.select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(F.count("*").alias("n"))
    near = sketches.adcount_by_key(lines, "l_returnflag", "l_partkey", 0.01).withColumnRenamed("n", "a")
    return near.join(exact, "l_returnflag").select("l_returnflag", "n", (F.abs(F.col("a") - F.col("n")) <= 0.05 * F.col("n")).alias("near"))


def percentiles_exact(spark, sf_dir):
    return sketches.percentiles_by_key(table(spark, sf_dir, "events"), "event_type", "value", [50, 90], exact=True).select("event_type", F.col("percentiles")[0].alias("p50"), F.col("percentiles")[1].alias("p90"))


def percentiles_rank(spark, sf_dir):
    """For each share, whether at least so many less 1 % of the rows lie at or below the approximate
    percentile, and at most so many more 1 % below it."""
    events = table(spark, sf_dir, "events")
    shares = F.array(F.lit(10), F.lit(50), F.lit(90))
    approx = sketches.percentiles(events, "value", [10, 50, 90])
    each = events.select("value").crossJoin(F.broadcast(approx)).select("value", F.posexplode("percentiles").alias("i", "q"))
    counts = each.groupBy("i").agg(F.avg((F.col("value") <= F.col("q")).cast("int")).alias("hi"), F.avg((F.col("value") < F.col("q")).cast("int")).alias("lo"))
    p = F.element_at(shares, F.col("i") + 1)
    return counts.select(p.cast("int").alias("p"), ((F.col("hi") >= p / 100 - 0.01) & (F.col("lo") <= p / 100 + 0.01)).alias("near"))


def table_aggs(spark, sf_dir):
    return as_table(table(spark, sf_dir, "events"), sequence="event_id").group_by("event_type", n="count(*)", lo="min(value)", hi="max(value)", last_user="last(user_id)").df


def group_concat(spark, sf_dir):
    return as_table(table(spark, sf_dir, "events"), sequence="event_id").group_by("user_id", types="group_concat(event_type)").df


def execute_clauses(spark, sf_dir):
    return as_table(table(spark, sf_dir, "events"), sequence="event_id").execute("select event_type, count(*) as n, avg(user_id) as u from events where value > 10 and user_id <> 3 group by event_type having count(*) > 5 order by n desc").df


def execute_join(spark, sf_dir):
    nation = as_table(table(spark, sf_dir, "nation"), name="nation_t")
    return as_table(table(spark, sf_dir, "supplier")).execute("select s_suppkey, n_name from supplier inner join each nation_t on supplier.s_nationkey = nation_t.n_nationkey where n_name != 'X'", {"nation_t": nation}).df


def top_by_key_small(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return keyed.top_by_key(events, "user_id", "value", 3, ties="event_id")


def top_by_key_large(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return keyed.top_by_key(events, "user_id", "value", 3, reverse=True, ties="event_id")


def _join(kind):
    def query(spark, sf_dir):
        return joins.join_pair(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", kind).select("c_custkey", "o_orderkey")

    return query


def join_broadcast(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.broadcast_join(table(spark, sf_dir, "customer"), nation, "c_nationkey").select("c_custkey", "n_name")


def join_last_match(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("k"))
    return joins.left_join_last(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "k")


def join_null_safe(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.col("event_id").alias("l"), F.expr("nullif(event_id % 26, 25)").alias("k"))
    b = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("r"), F.expr("nullif(n_nationkey, 0)").cast("bigint").alias("k"))
    return joins.join(a, b, "k", null_safe=True).select("l", "r")


def cogroup_counts(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("v"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("v"))
    made = joins.cogroup([a, b], "k", "v")
    return made.select("k", F.size("values_0").cast("bigint").alias("nc"), F.size("values_1").cast("bigint").alias("ns"))


def cartesian(spark, sf_dir):
    return joins.cartesian(table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "nation").select("n_name"))


def semi_by_set(spark, sf_dir):
    rich = table(spark, sf_dir, "orders").filter("o_totalprice > 100000")
    return joins.semi_by_set(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", rich, "o_custkey")


def skew_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, 7).otherwise(F.col("event_id") % 25).cast("int").alias("k"))
    return joins.skew_join(events, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), "k")


def _upsert(replace_only):
    def query(spark, sf_dir):
        customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
        old, new = customers.filter("k % 2 = 0").withColumn("v", F.lit("old")), customers.filter("k % 3 = 0").withColumn("v", F.lit("new"))
        return keyed.upsert(old, new, "k", "v", replace_only)

    return query


def lookup(spark, sf_dir):
    found = keyed.lookup(table(spark, sf_dir, "nation"), "n_nationkey", 7, "n_name")
    return spark.createDataFrame([(found,)], "v string")


QUERIES = {
    "reduce_by_key": reduce_by_key, "combine_by_key": combine_by_key, "fold_by_key": fold_by_key, "group_by_key": group_by_key, "uniq": uniq,
    "hot_10": hot_10, "atop_counts": atop_counts, "global_agg": global_agg, "adcount_error": adcount_error, "adcount_by_key_error": adcount_by_key_error,
    "percentiles_exact": percentiles_exact, "percentiles_rank": percentiles_rank, "table_aggs": table_aggs, "group_concat": group_concat,
    "execute_clauses": execute_clauses, "execute_join": execute_join, "top_by_key_small": top_by_key_small, "top_by_key_large": top_by_key_large,
    **{f"join_{kind}": _join(kind) for kind in ("inner", "left", "right", "full")},
    "join_broadcast": join_broadcast, "join_last_match": join_last_match, "join_null_safe": join_null_safe, "cogroup_counts": cogroup_counts,
    "cartesian": cartesian, "semi_by_set": semi_by_set, "skew_join": skew_join, "upsert": _upsert(False), "upsert_replace_only": _upsert(True), "lookup": lookup,
}

_ALL = "SELECT c_custkey, o_orderkey FROM customer {} JOIN orders ON c_custkey=o_custkey"
_UPSERT = "SELECT k, coalesce(n.v,o.v) AS v FROM (SELECT c_custkey k, 'old' v FROM customer WHERE c_custkey%2=0) o {} JOIN (SELECT c_custkey k, 'new' v FROM customer WHERE c_custkey%3=0) n USING (k)"
_TOP = "SELECT user_id, event_id, value, rk FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value {}, event_id) AS rk FROM events) WHERE rk<=3"

SQL = {
    "reduce_by_key": "SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1",
    "combine_by_key": "SELECT event_type, count(*) AS n, min(value) AS lo FROM events GROUP BY 1",
    "fold_by_key": "SELECT event_type, CAST(sum(user_id) AS BIGINT) AS s FROM events GROUP BY 1",
    "group_by_key": "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events GROUP BY 1",
    "uniq": "SELECT DISTINCT user_id, event_type FROM events",
    "hot_10": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "atop_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "global_agg": "SELECT count(*) AS n, min(value) AS lo, max(value) AS hi, CAST(sum(event_id) AS BIGINT) AS s FROM events",
    "adcount_error": "SELECT count(DISTINCT l_partkey) AS n, TRUE AS near FROM lineitem",
    "adcount_by_key_error": "SELECT l_returnflag, count(DISTINCT l_partkey) AS n, TRUE AS near FROM lineitem GROUP BY 1",
    "percentiles_exact": "SELECT event_type, quantile_cont(value,0.5) AS p50, quantile_cont(value,0.9) AS p90 FROM events GROUP BY 1",
    "percentiles_rank": "SELECT unnest([10, 50, 90]) AS p, TRUE AS near",
    "table_aggs": "SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi, arg_max(user_id, event_id) AS last_user FROM events GROUP BY 1",
    "group_concat": "SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS types FROM events GROUP BY 1",
    "execute_clauses": "SELECT event_type, count(*) AS n, avg(user_id) AS u FROM events WHERE value>10 AND user_id<>3 GROUP BY 1 HAVING count(*)>5",
    "execute_join": "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey=n_nationkey",
    "top_by_key_small": _TOP.format(""),
    "top_by_key_large": _TOP.format("DESC"),
    **{f"join_{kind}": _ALL.format(kind.upper()) for kind in ("inner", "left", "right", "full")},
    "join_broadcast": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey=n_nationkey",
    "join_last_match": "SELECT c_custkey, k FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1) ON c_custkey=o_custkey",
    "join_null_safe": "SELECT a.event_id AS l, b.n_nationkey AS r FROM (SELECT event_id, nullif(event_id%26,25) AS k FROM events) a JOIN (SELECT n_nationkey, nullif(n_nationkey,0) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k",
    "cogroup_counts": "SELECT coalesce(c_nationkey,s_nationkey) AS k, coalesce(nc,0) AS nc, coalesce(ns,0) AS ns FROM (SELECT c_nationkey, count(*) nc FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) ns FROM supplier GROUP BY 1) ON c_nationkey=s_nationkey",
    "cartesian": "SELECT r_name, n_name FROM region, nation",
    "semi_by_set": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice>100000)",
    "skew_join": "SELECT k, event_id, n_name FROM (SELECT event_id, CAST(CASE WHEN event_id%3=0 THEN 7 ELSE event_id%25 END AS INTEGER) AS k FROM events) JOIN nation ON k=n_nationkey",
    "upsert": _UPSERT.format("FULL"),
    "upsert_replace_only": _UPSERT.format("LEFT"),
    "lookup": "SELECT n_name AS v FROM nation WHERE n_nationkey=7",
}
