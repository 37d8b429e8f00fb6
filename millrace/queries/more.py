"""Queries for actions, kept results, shared values, further joins, SQL forms and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions import hashing
from millrace.graph import pregel
from millrace.operators import actions, joins, keyed, partitions, sketches
from millrace.plans.relation import as_table
from millrace.queries.basic import table
from millrace.queries.sql_queries import engine
from millrace.queries.streams import _events, _local
from millrace.sources import files
from millrace.storage import scratch
from millrace.streaming import sources, state, windows


def _folder(spark, name):
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources, actions and kept results ---


def parallelized(spark, sf_dir):
    return actions.parallelize(spark, [(i, i * i) for i in range(100)], "i long, sq long", 4)


def collected_map(spark, sf_dir):
    found = files.collect_map(table(spark, sf_dir, "nation"), "n_nationkey", "n_name")
    return spark.createDataFrame(sorted(found.items()), "k int, v string")


def taken_rows(spark, sf_dir):
    return spark.createDataFrame(as_table(table(spark, sf_dir, "nation")).sort("n_nationkey").take(3))


def folded(spark, sf_dir):
    return actions.fold(table(spark, sf_dir, "events"), "event_id", F.lit(0).cast("bigint"), lambda a, v: a + v * 2, lambda a, b: a + b)


def folded_by_chunks(spark, sf_dir):
    """Whether a key's first and last user in the order of events are found by merging runs."""
    pair = F.struct(F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"))
    step = lambda s, v: F.struct(F.coalesce(s["a"], v).alias("a"), v.alias("b"))
    join = lambda s, t: F.struct(F.coalesce(s["a"], t["a"]).alias("a"), F.coalesce(t["b"], s["b"]).alias("b"))
    made = keyed.fold_by_key(table(spark, sf_dir, "events"), "event_type", "user_id", pair, step, None, "event_id", "x", combine=join)
    return made.select("event_type", "x.a", "x.b")


def reduced_to_driver(spark, sf_dir):
    found = actions.reduce_to_driver(table(spark, sf_dir, "events"), "event_type", "event_id", "max")
    return spark.createDataFrame(sorted(found.items()), "k string, v long")


def counted_by_tasks(spark, sf_dir):
    """Totals gathered by each row's and each partition's function, and while an action runs."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    rows, kinds = actions.accumulator(spark, 0), actions.accumulator(spark, set())

    def add(part):
        seen = [r["event_type"] for r in part]
        rows.add(len(seen))
        kinds.add(set(seen))

    actions.foreach_partition(events, add)
    each = actions.accumulator(spark, 0)
    actions.foreach(table(spark, sf_dir, "nation"), lambda r: each.add(r["n_nationkey"]))
    totals = actions.Totals(events, n=F.count("*"), top=F.max("event_id"))
    totals.df.write.format("noop").mode("overwrite").save()
    found = totals.get()
    return spark.createDataFrame([(rows.value, len(kinds.value), each.value, found["n"], found["top"])], "rows long, kinds long, keys long, n long, top long")


def chosen_partitions(spark, sf_dir):
    double = lambda frames: ((f.assign(id=f["id"] * 2)) for f in frames)
    return actions.on_partitions(spark.range(0, 100, 1, 10), [2, 5], double, "id long")


def kept_results(spark, sf_dir):
    """Cached, checkpointed and stored once, a table is the same."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    path = _folder(spark, "snapshot")
    actions.snapshot(nation, path)
    stored = actions.snapshot(nation.limit(0), path)
    with actions.cached(nation.filter("n_nationkey < 10")) as low:
        assert low.count() == low.count()
        first = actions.checkpointed(low)
    return first.unionByName(stored.filter("n_nationkey >= 10"))


def shared_lookup(spark, sf_dir):
    names = actions.shared_value(spark, {r[0]: r[1] for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()})

    def look(frames):
        for f in frames:
            yield f.assign(n_name=f["c_nationkey"].map(names.value))[["c_custkey", "n_name"]]

    return partitions.map_partitions_udf(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), look, "c_custkey long, n_name string")


def shared_map(spark, sf_dir):
    """The last of three versions; one write gives a key two values, another deletes one."""
    nation = table(spark, sf_dir, "nation")
    shared = actions.SharedMap(spark, "int", "string")
    shared.put(nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")))
    shared.put(nation.filter("n_nationkey < 5").select(F.col("n_regionkey").alias("k"), F.concat(F.lit("r"), "n_name").alias("v")))
    shared.put({24: None})
    return shared.table().select("k", F.array_join("v", "|").alias("v"))


def with_resources(spark, sf_dir):
    plus = lambda frames: (f + 1 for f in frames)
    return actions.map_partitions_with(table(spark, sf_dir, "nation").select("n_nationkey"), plus, "n_nationkey int", cpus=2)


# --- keys and joins ---


def key_partitions(spark, sf_dir):
    made = keyed.partition_by_key(table(spark, sf_dir, "events").select("user_id"), "user_id", 7)
    return partitions.enumerate_partition(made).groupBy("user_id").agg(F.count_distinct("partition").alias("n"))


def join_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.join(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", hint="merge")


def _relation_join(method, **more):
    def query(spark, sf_dir):
        suppliers = as_table(table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + 3).alias("k")))
        nations = as_table(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name"))
        return getattr(suppliers, method)(nations, **more).select("k", "s_suppkey", "n_name").df

    return query


def group_by_function(spark, sf_dir):
    made = keyed.group_by_key(table(spark, sf_dir, "events"), F.year("ts").alias("y"), "event_id", order="event_id")
    return made.select("y", F.size("values").cast("bigint").alias("n"), F.col("values")[0].alias("first"))


def table_top(spark, sf_dir):
    made = as_table(table(spark, sf_dir, "events")).select_one(t="top(event_type[:3])", d="adcount(event_type)").df
    return made.select(F.explode("t").alias("x"), "d").select(F.col("x.item").alias("item"), F.col("x.count").alias("n"), "d")


def salted_lists(spark, sf_dir):
    made = keyed.salted_aggregate(table(spark, sf_dir, "events"), ["event_type"], {"ids": F.collect_set("user_id")}, {"ids": F.flatten(F.collect_list("ids"))})
    return made.select("event_type", F.size(F.array_distinct("ids")).cast("bigint").alias("n"))


def table_sort(spark, sf_dir):
    made = as_table(table(spark, sf_dir, "nation")).sort("n_name", reverse=True).df
    return made.select("n_name", F.monotonically_increasing_id().alias("at"))


def concatenated(spark, sf_dir):
    return as_table(table(spark, sf_dir, "nation")).select("n_nationkey", "n_name + '-' + str(n_regionkey) as s").df


def bit_positions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    a, b = (events.filter(c).select(F.col("user_id").alias("pos")).distinct() for c in ("event_type = 'click'", "value > 90"))
    parts = [sketches.positions(a, how, b).select(F.lit(how).alias("how"), "pos") for how in ("intersect", "union", "xor", "except")]
    return joins.union(parts).groupBy("how").agg(F.count("*").alias("n"), F.sum("pos").alias("s"))


def bitmaps(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    made = sketches.bitmap_union(sketches.bitmap(events, ["event_type", "user_id"], "event_id").select("event_type", "bucket", "bits"), ["event_type"])
    return made.groupBy("event_type").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def stored_sketches(spark, sf_dir):
    """Sketches by day, merged by type."""
    events = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    merged = sketches.merge_distinct(sketches.distinct_sketch(events, ["event_type", "d"], "user_id"), ["event_type"])
    exact = events.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("*").alias("e"))
    return merged.join(exact, "event_type").select("event_type", F.col("e").alias("n"), (F.abs(F.col("n") - F.col("e")) <= 0.05 * F.col("e")).alias("near"))


def fnv_hashes(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", hashing.fnv1a("n_name").alias("h"))


def map_functions(spark, sf_dir):
    made = as_table(table(spark, sf_dir, "nation")).select("n_nationkey", "dict(n_name.split(' '), sorted(n_name.split(' '))) as m")
    return made.select("n_nationkey", "'/'.join(m.keys()) as k", "m.get('UNITED', 'none') as u", "m.keys().index('KINGDOM') as i").select("n_nationkey", "k", "u", "int(i) as i").df


def table_function(spark, sf_dir):
    """Words of a name with their places, from a Python table function."""

    @F.udtf(returnType="at int, word string")
    class Words:
        def eval(self, text: str):
            yield from enumerate(text.split(" "))

    return keyed.flat_map_udtf(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), Words, "n_name").select("n_nationkey", "at", "word")


# --- SQL ---


def _sql(text):
    return lambda spark, sf_dir: engine(spark, sf_dir).query(text)


def sql_show_tables(spark, sf_dir):
    made = engine(spark, sf_dir)
    made.run("DROP TABLE region;")
    return spark.createDataFrame([(n,) for n in made.run('SHOW TABLES;')[0]], "name string")


def sql_function(spark, sf_dir):
    made = engine(spark, sf_dir)
    made.allow_python = True
    made.run('$"def half(x): return x / 2";')
    return made.query("SELECT event_id, half(value) AS h FROM events;")


def table_saved(spark, sf_dir):
    path = _folder(spark, "saved")
    as_table(table(spark, sf_dir, "nation")).select("n_name as name", "n_regionkey as region").save(path)
    return spark.read.parquet(path)


def selected_files(spark, sf_dir):
    """Only the files that the selectors after a table's name choose."""
    path = _folder(spark, "parts")
    made = engine(spark, sf_dir)
    for day, low in (("a", 0), ("b", 10), ("c", 20)):
        files.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name").filter(F.col("n_nationkey").between(low, low + 9)), f"{path}/{day}")
    made.run(f'CREATE TABLE n (k int, name) FROM "{path}";')
    return made.query('SELECT k, name FROM n<"a", "c">;')


# --- streams and graphs ---


def stream_files(spark, sf_dir):
    path = _folder(spark, "lines")
    files.write_text(table(spark, sf_dir, "nation").select("n_name").repartition(3), path)
    return state.to_end(sources.text_stream(spark, path, 1).withColumnRenamed("value", "line"))


def stream_tail(spark, sf_dir):
    path = _folder(spark, "tailed")
    files.write_text(table(spark, sf_dir, "nation").select("n_name"), path)
    return state.to_end(sources.tail(spark, path, suffix=".txt").select(F.col("value").alias("line")))


def stream_window_sums(spark, sf_dir):
    """Sums by key over the last two of three batches; keys that have left stay with 0."""
    last = []
    nation = table(spark, sf_dir, "nation")
    batches = [nation.filter(F.col("n_regionkey") == r).select(F.col("n_regionkey").cast("long").alias("k"), F.col("n_nationkey").cast("long").alias("v")) for r in (0, 1, 2)]
    path = _folder(spark, "batches")
    for n, b in enumerate(batches):
        b.coalesce(1).write.json(f"{path}/batch={n}")
    stream = spark.readStream.schema("k long, v long").option("maxFilesPerTrigger", 1).json(f"{path}/*")
    folder = _folder(spark, "sums")
    writer = state.reduce_by_key_and_window(stream, "k", "v", 2, folder, "bigint", "bigint", True, 1, lambda df, n: last.append(df))
    writer.trigger(availableNow=True).start().awaitTermination()
    return last[-1].select("k", "v")


def stream_cogroup(spark, sf_dir):
    events = _events(spark, sf_dir)
    clicks, views = (events.filter(F.col("event_type") == t).select("ts", "user_id", "event_id") for t in ("click", "view"))
    made = windows.stream_cogroup(clicks, views, ["user_id"], "ts", "ts", "1 day", "event_id", "event_id")
    return _local(state.to_end(made.select("w", "user_id", F.array_join(F.transform("lefts", lambda x: x.cast("string")), ",").alias("c"), F.size("rights").cast("bigint").alias("v")), "complete"))


def stream_slice(spark, sf_dir):
    made = state.to_end(windows.count_by_window(_events(spark, sf_dir), "ts", "1 day"), "complete")
    return _local(windows.window_slice(made, "2024-01-05", "2024-01-10"))


def stream_foreach(spark, sf_dir):
    """Each batch's events, written under its number by the caller's function."""
    folder = _folder(spark, "each")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    state.for_each_batch(_events(spark, sf_dir).select("event_id"), write, folder).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", F.col("batch").cast("int").alias("batch"))


def stream_static(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), "n_name")
    stream = _events(spark, sf_dir).select("event_id", (F.col("user_id") % 25).alias("k"))
    return state.to_end(windows.with_static(stream, names, ["k"]).select("event_id", "n_name"))


def graph_aggregate(spark, sf_dir):
    """Supersteps until the sum of all vertices, which each one sees, is large enough."""
    nation = table(spark, sf_dir, "nation")
    start = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.lit(1).cast("long").alias("x"), F.lit(True).alias("active"))
    edges = nation.select(F.col("n_nationkey").cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    update = lambda step: {"x": F.col("x") + F.coalesce(step.message, F.lit(0)), "active": F.lit(step.aggregate < 100)}
    none = spark.createDataFrame([], "dst long, msg long")
    return pregel.run(start, edges, none, update, F.lit(1).cast("long"), "sum", F.col("active"), F.sum("x"), 20).select("id", "x")


QUERIES = {
    "parallelized": parallelized, "collected_map": collected_map, "taken_rows": taken_rows, "folded": folded, "folded_by_chunks": folded_by_chunks,
    "reduced_to_driver": reduced_to_driver, "counted_by_tasks": counted_by_tasks, "chosen_partitions": chosen_partitions, "kept_results": kept_results,
    "shared_lookup": shared_lookup, "shared_map": shared_map, "with_resources": with_resources, "key_partitions": key_partitions, "join_merge": join_merge,
    "table_join": _relation_join("join"), "table_inner_join": _relation_join("inner_join"), "table_right_join": _relation_join("right_outer_join"), "table_outer_join": _relation_join("outer_join"),
    "group_by_function": group_by_function, "table_top": table_top, "salted_lists": salted_lists, "table_sort": table_sort, "concatenated": concatenated, "fnv_hashes": fnv_hashes, "map_functions": map_functions, "table_function": table_function,
    "bit_positions": bit_positions, "bitmaps": bitmaps, "stored_sketches": stored_sketches,
    "sql_right_join": _sql("SELECT s.s_suppkey AS s_suppkey, n.n_name AS n_name FROM supplier AS s RIGHT JOIN nation AS n USING (s.s_nationkey, n.n_nationkey);"),
    "sql_outer_join": _sql("SELECT s.s_suppkey AS s_suppkey, c.c_custkey AS c_custkey FROM supplier AS s OUTER JOIN customer AS c USING (s.s_suppkey, c.c_nationkey);"),
    "sql_adcount": _sql("SELECT event_type, ADCOUNT(event_type) AS n FROM events GROUP BY event_type;"),
    "sql_subquery_limit": _sql("SELECT COUNT(*) AS n, MAX(q.e) AS top FROM (SELECT event_id AS e FROM events ORDER BY e LIMIT 7) AS q;"),
    "sql_show_tables": sql_show_tables, "sql_function": sql_function, "table_saved": table_saved, "selected_files": selected_files,
    "stream_files": stream_files, "stream_tail": stream_tail, "stream_window_sums": stream_window_sums, "stream_cogroup": stream_cogroup,
    "stream_slice": stream_slice, "stream_static": stream_static, "stream_foreach": stream_foreach, "graph_aggregate": graph_aggregate,
}

_TABLE = "SELECT coalesce(s.k, n.n_nationkey) AS k, s_suppkey, n_name FROM (SELECT s_suppkey, s_nationkey + 3 AS k FROM supplier) s {} JOIN nation n ON s.k = n.n_nationkey"

SQL = {
    "parallelized": "SELECT i, i * i AS sq FROM range(100) t(i)",
    "collected_map": "SELECT n_nationkey AS k, n_name AS v FROM nation",
    "taken_rows": "SELECT * FROM nation ORDER BY n_nationkey LIMIT 3",
    "folded": "SELECT CAST(2 * sum(event_id) AS BIGINT) AS value FROM events",
    "folded_by_chunks": "SELECT event_type, arg_min(user_id, event_id) AS a, arg_max(user_id, event_id) AS b FROM events GROUP BY 1",
    "reduced_to_driver": "SELECT event_type AS k, max(event_id) AS v FROM events GROUP BY 1",
    "counted_by_tasks": "SELECT count(*) AS rows, count(DISTINCT event_type) AS kinds, (SELECT CAST(sum(n_nationkey) AS BIGINT) FROM nation) AS keys, count(*) AS n, max(event_id) AS top FROM events",
    "chosen_partitions": "SELECT 2 * i AS id FROM range(100) t(i) WHERE i // 10 IN (2, 5)",
    "kept_results": "SELECT n_nationkey, n_name FROM nation",
    "shared_lookup": "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "shared_map": "WITH w AS (SELECT n_regionkey AS k, string_agg(DISTINCT 'r' || n_name, '|' ORDER BY 'r' || n_name) AS v FROM nation WHERE n_nationkey < 5 GROUP BY 1) SELECT n_nationkey AS k, coalesce(w.v, n_name) AS v FROM nation LEFT JOIN w ON w.k = n_nationkey WHERE n_nationkey <> 24",
    "with_resources": "SELECT n_nationkey + 1 AS n_nationkey FROM nation",
    "key_partitions": "SELECT DISTINCT user_id, 1 AS n FROM events",
    "join_merge": "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey",
    "table_join": _TABLE.format("INNER"), "table_inner_join": _TABLE.format("INNER"), "table_right_join": _TABLE.format("RIGHT"), "table_outer_join": _TABLE.format("FULL"),
    "group_by_function": "SELECT CAST(year(ts) AS INTEGER) AS y, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1",
    "table_top": "SELECT event_type[1:3] AS item, count(*) AS n, (SELECT count(DISTINCT event_type) FROM events) AS d FROM events GROUP BY 1",
    "salted_lists": "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1",
    "table_sort": "SELECT n_name, row_number() OVER (ORDER BY n_name DESC) - 1 AS at FROM nation",
    "concatenated": "SELECT n_nationkey, n_name || '-' || n_regionkey AS s FROM nation",
    "fnv_hashes": "SELECT n_name, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, length(n_name) + 1), lambda i: CAST(ascii(n_name[i]) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS h FROM nation",
    "map_functions": "SELECT n_nationkey, replace(n_name, ' ', '/') AS k, CASE WHEN list_contains(string_split(n_name, ' '), 'UNITED') THEN list_sort(string_split(n_name, ' '))[list_position(string_split(n_name, ' '), 'UNITED')] ELSE 'none' END AS u, CAST(coalesce(list_position(string_split(n_name, ' '), 'KINGDOM'), 0) - 1 AS BIGINT) AS i FROM nation",
    "table_function": "SELECT n_nationkey, CAST(i - 1 AS INTEGER) AS at, w[i] AS word FROM (SELECT n_nationkey, string_split(n_name, ' ') AS w, unnest(range(1, len(string_split(n_name, ' ')) + 1)) AS i FROM nation)",
    "bit_positions": "WITH a AS (SELECT DISTINCT user_id AS p FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id AS p FROM events WHERE value > 90), u AS (SELECT coalesce(a.p, b.p) AS p, a.p IS NOT NULL AS x, b.p IS NOT NULL AS y FROM a FULL JOIN b ON a.p = b.p), h AS (SELECT 'intersect' AS how, p FROM u WHERE x AND y UNION ALL SELECT 'union', p FROM u UNION ALL SELECT 'xor', p FROM u WHERE x <> y UNION ALL SELECT 'except', p FROM u WHERE x AND NOT y) SELECT how, count(*) AS n, CAST(sum(p) AS BIGINT) AS s FROM h GROUP BY 1",
    "bitmaps": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "stored_sketches": "SELECT event_type, count(DISTINCT user_id) AS n, TRUE AS near FROM events GROUP BY 1",
    "sql_right_join": "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "sql_outer_join": "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_nationkey",
    "sql_adcount": "SELECT event_type, 1 AS n FROM events GROUP BY 1",
    "sql_subquery_limit": "SELECT count(*) AS n, max(event_id) AS top FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 7)",
    "sql_show_tables": "SELECT unnest(['customer', 'events', 'lineitem', 'nation', 'orders', 'part', 'supplier']) AS name",
    "sql_function": "SELECT event_id, value / 2 AS h FROM events",
    "table_saved": "SELECT n_name AS name, n_regionkey AS region FROM nation",
    "selected_files": "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation WHERE n_nationkey NOT BETWEEN 10 AND 19",
    "stream_files": "SELECT n_name AS line FROM nation", "stream_tail": "SELECT n_name AS line FROM nation",
    "stream_window_sums": "SELECT CAST(n_regionkey AS BIGINT) AS k, CAST(sum(CASE WHEN n_regionkey > 0 THEN n_nationkey ELSE 0 END) AS BIGINT) AS v FROM nation WHERE n_regionkey < 3 GROUP BY 1",
    "stream_cogroup": "SELECT time_bucket(INTERVAL '1 day', ts) AS w, user_id, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE event_type = 'click'), '') AS c, count(*) FILTER (WHERE event_type = 'view') AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2",
    "stream_slice": "SELECT time_bucket(INTERVAL '1 day', ts) AS w, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-06' AND ts < TIMESTAMP '2024-01-11' GROUP BY 1",
    "stream_foreach": "SELECT event_id, 0 AS batch FROM events",
    "stream_static": "SELECT event_id, n_name FROM events JOIN nation ON user_id % 25 = n_nationkey",
    # The sum is 25 at first and grows by 25 a step; all send until they have seen 100.
    "graph_aggregate": "SELECT CAST(n_nationkey AS BIGINT) AS id, 1 + 4 * (SELECT count(*) FROM nation b WHERE b.n_regionkey = a.n_nationkey) AS x FROM nation a",
}
