"""Queries in the compact SQL dialect."""

from __future__ import annotations

from millrace.queries.basic import table
from millrace.sql.engine import Compat, Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def engine(spark, sf_dir, compat=None):
    made = Engine(spark, compat)
    for t in TABLES:
        made.register(t, table(spark, sf_dir, t))
    return made


def _query(text, compat=None):
    return lambda spark, sf_dir: engine(spark, sf_dir, compat).query(text)


QUERIES = {
    "sql_distinct_aggs": _query("SELECT event_type, COUNT(DISTINCT user_id) AS du, SUM(DISTINCT user_id) AS su, COUNT(*) AS n FROM events GROUP BY event_type;"),
    "sql_having": _query("SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id HAVING n > 70 ORDER BY n DESC;"),
    "sql_any_value": _query("SELECT o_custkey, MIN(o_orderkey) AS k FROM orders GROUP BY o_custkey;"),
    "sql_first_row": _query("SELECT event_type, event_type AS t, COUNT(value) AS n FROM events GROUP BY event_type;", Compat.all()),
    "sql_using_pair": _query("SELECT o_orderkey, c_name FROM orders INNER JOIN customer USING (o_custkey, c_custkey);"),
    "sql_comma_join": _query("SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND NOT n_name IN (\"X\");"),
    "sql_like_regex": _query('SELECT p_partkey FROM part WHERE p_type LIKE "[A-M]";'),
    "sql_subquery": _query("SELECT t, MAX(n) AS m FROM (SELECT event_type AS t, user_id, COUNT(*) AS n FROM events GROUP BY event_type, user_id) AS q GROUP BY t;"),
    "sql_order_limit": _query("SELECT event_id, value * 2 + 1 AS v FROM events WHERE value >= 10 AND (event_type = \"click\" OR event_type <> \"view\") ORDER BY v DESC, event_id LIMIT 20;"),
    "sql_global": _query("SELECT COUNT(*) AS n, AVG(user_id) AS a, MIN(value) AS lo, MAX(value) AS hi FROM events WHERE value > 5;"),
    "sql_python_expr": _query('SELECT event_id, $"event_type[:2].upper()" AS t FROM events WHERE $"value > 90 and event_id % 2 == 0";'),
    "sql_left_pair": _query("SELECT c.c_custkey AS c_custkey, o.o_orderkey AS o_orderkey FROM customer AS c LEFT JOIN orders AS o USING (c.c_custkey, o.o_custkey);"),
}

SQL = {
    "sql_distinct_aggs": "SELECT event_type, count(DISTINCT user_id) AS du, CAST(sum(DISTINCT user_id) AS BIGINT) AS su, count(*) AS n FROM events GROUP BY 1",
    "sql_having": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*)>70",
    "sql_any_value": "SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1",
    "sql_first_row": "SELECT event_type, event_type AS t, count(*) AS n FROM events GROUP BY 1",
    "sql_using_pair": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey=c_custkey",
    "sql_comma_join": "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey=n_nationkey",
    "sql_like_regex": "SELECT p_partkey FROM part WHERE regexp_matches(p_type,'^(?:[A-M])')",
    "sql_subquery": "SELECT t, max(n) AS m FROM (SELECT event_type AS t, user_id, count(*) AS n FROM events GROUP BY 1,2) GROUP BY 1",
    "sql_order_limit": "SELECT event_id, value*2+1 AS v FROM events WHERE value>=10 AND (event_type='click' OR event_type<>'view') ORDER BY v DESC, event_id LIMIT 20",
    "sql_global": "SELECT count(*) AS n, avg(user_id) AS a, min(value) AS lo, max(value) AS hi FROM events WHERE value>5",
    "sql_python_expr": "SELECT event_id, upper(event_type[1:2]) AS t FROM events WHERE value>90 AND event_id%2=0",
    "sql_left_pair": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey=o_custkey",
}
