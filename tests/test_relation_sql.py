"""Relations, expression strings, the SQL dialect and its console."""

import io

import pytest
from conftest import rows

from millrace.functions.expressions import ExpressionError, expression
from millrace.plans.relation import as_table, auto_name, split_alias, split_top
from millrace.sql import parser as P
from millrace.sql.console import Console, ascii_table
from millrace.sql.engine import Compat, Engine
from millrace.sql.parser import SqlError


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "ann", 10.0, "x"), (2, "bob", 20.0, "y"), (3, "cy", None, "x"), (4, None, 5.0, "x")], "id long, name string, pay double, team string")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("id * 2 + 1", [3, 5, 7, 9]),
        ("id // 2", [0, 1, 1, 2]),
        ("-id % 3", [2, 1, 0, 2]),
        ("id / 0", [None] * 4),
        ("math.sqrt(id * id)", [1, 2, 3, 4]),
        ("name.upper() + '!'", ["ANN!", "BOB!", "CY!", None]),
        ("name[1:]", ["nn", "ob", "y", None]),
        ("name[-2:]", ["nn", "ob", "cy", None]),
        ("len(name)", [3, 3, 2, None]),
        ("1 if pay is None else 0", [0, 0, 1, 0]),
        ("1 < id <= 3", [False, True, True, False]),
        ("team in ('y', 'z')", [False, True, False, False]),
        ("not (id > 1 and id < 4)", [True, False, False, True]),
        ("rmatch(name, 'a|b')", [True, True, False, None]),
        ("'a-b-c'.split('-')[-1]", ["c"] * 4),
        ("max(id, 2)", [2, 2, 3, 4]),
        ("copysign(3, -id)", [-3, -3, -3, -3]),
    ],
)
def test_expressions(people, text, expected):
    assert [r[0] for r in people.select(expression(text, people.columns), "id").orderBy("id").collect()] == expected


@pytest.mark.parametrize("text", ["__import__('os')", "id.__class__", "[x for x in id]", "lambda: 1", "nothing", "open('f')", "id +", "print(1)", "id if"])
def test_expressions_are_a_whitelist(people, text):
    with pytest.raises(ExpressionError):
        expression(text, people.columns)


def test_names():
    assert auto_name("sum(a, b)") == "sum_a__b_"
    assert split_alias("a + b as c") == ("a + b", "c")
    assert split_top("a, f(b, c), 'x,y'") == ["a", "f(b, c)", "'x,y'"]


def test_relation(people):
    t = as_table(people, sequence="id")
    assert rows(t.where("pay > 6", "team = 'x'" .replace("=", "==")).select("name").df) == [("ann",)]
    assert rows(t.group_by("team", n="count(*)", p="count(pay)", names="group_concat(name)", last="last(id)").df) == [("x", 3, 2, "ann,cy", 4), ("y", 1, 1, "bob", 2)]
    assert rows(t.select_one("sum(pay) as s", "min(id) as lo", "avg(pay) as a").df) == [(35.0, 1, 35 / 3)]
    assert [r["id"] for r in t.top(2, "id").collect()] == [4, 3]
    assert [r["id"] for r in t.top(2, "id", reverse=True).collect()] == [1, 2]
    assert t.sort("team, id", reverse=True).collect()[0]["id"] == 2
    assert dict(t.atop("team"))["x"] == 3
    assert t.index_by().first()["key"]["id"] == 1
    with pytest.raises(ExpressionError):
        t.select("id", "name as id")
    with pytest.raises(ExpressionError):
        t.group_by("team", "name")
    listed = as_table(people, collect_bare=True).group_by("team", "id")
    assert sorted(map(sorted, (r["id"] for r in listed.collect()))) == [[1, 3, 4], [2]]


def test_relation_joins(spark, people):
    t = as_table(people)
    pay = as_table(spark.createDataFrame([("x", 1), ("x", 2), ("z", 3)], "team string, bonus int"), sequence="bonus")
    assert t.join(pay).df.count() == 6
    assert t.inner_join(pay).df.count() == 6
    assert t.left_outer_join(pay).df.count() == 7
    assert sorted(r["bonus"] or 0 for r in t.left_outer_join(pay, last_only=True).collect()) == [0, 2, 2, 2]
    assert t.right_outer_join(pay).df.count() == 7
    assert t.outer_join(pay).df.count() == 8
    renamed = as_table(spark.createDataFrame([("x", 9)], "t string, b int"))
    assert t.join(renamed, "team", "t").df.columns == ["team", "id", "name", "pay", "b"]


def test_execute(spark, people):
    t = as_table(people, sequence="id")
    assert rows(t.execute("select team, count(*) as n from people where id <> 2 group by team having count(*) > 1").df) == [("x", 3)]
    assert [r["id"] for r in t.execute("select id from t order by id desc limit 2").collect()] == [4, 3]
    assert rows(t.execute("select count(*) as n, max(id) as m from t").df) == [(4, 4)]
    other = as_table(spark.createDataFrame([(1, "p")], "k int, v string"))
    assert rows(t.execute("select id, v from t left outer join o on t.id = o.k where id < 3", {"o": other}).df) == [(1, "p"), (2, None)]
    with pytest.raises(ExpressionError):
        t.execute("from t")


@pytest.fixture
def engine(spark, people):
    made = Engine(spark)
    made.register("people", people)
    made.register("team", spark.createDataFrame([("x", "red"), ("z", "blue"), (None, "grey")], "code string, color string"))
    return made


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SELECT id FROM people WHERE pay >= 10 AND NOT team = \"y\"", [(1,)]),
        ("SELECT id AS i, id + 0.5 AS h FROM people WHERE id IN (1, 3)", [(1, 1.5), (3, 3.5)]),
        ("SELECT id FROM people WHERE name LIKE \"a|c\"", [(1,), (3,)]),
        ("SELECT id FROM people WHERE name NOT LIKE \"a\" OR pay IS NULL", [(2,), (3,)]),
        ("SELECT team, COUNT(*) AS n, SUM(pay) AS s FROM people GROUP BY team HAVING n > 1", [("x", 3, 15.0)]),
        ("SELECT team, COUNT(pay) AS n FROM people GROUP BY team HAVING COUNT(pay) = 2", [("x", 2)]),
        ("SELECT COUNT(DISTINCT team) AS t, AVG(pay) * 2 AS a FROM people", [(2, 70 / 3)]),
        ("SELECT people.id AS id, t.color AS c FROM people INNER JOIN team AS t USING (people.team, t.code)", [(1, "red"), (3, "red"), (4, "red")]),
        ("SELECT color AS c, id FROM people RIGHT JOIN team USING (team, code) WHERE id IS NULL", [("blue", None), ("grey", None)]),
        ("SELECT COUNT(*) AS n FROM people, team", [(12,)]),
        ("SELECT m FROM (SELECT team AS t, MAX(id) AS m FROM people GROUP BY team) AS q WHERE q.t = \"x\"", [(4,)]),
        ("SELECT * FROM team WHERE code BETWEEN \"x\" AND \"y\"", [("x", "red")]),
        ("SELECT $\"name[0:1]\" AS f FROM people WHERE $\"id == 2\"", [("b",)]),
        ("SELECT `id` FROM people WHERE -id < -3", [(4,)]),
        ("SELECT 1 + 2 * 3 AS v, \"a\" + \"b\" AS s FROM people LIMIT 1", [(7.0, "ab")]),
        ("SELECT id FROM people LIMIT 0", []),
        ("SELECT ADCOUNT(team) AS a, ADCOUNT(*) AS b FROM people", [(2, 4)]),
    ],
)
def test_select(engine, text, expected):
    assert sorted(map(tuple, engine.query(text + ";").collect()), key=str) == sorted(expected, key=str)


def test_order(engine):
    assert [r[0] for r in engine.query("SELECT id FROM people ORDER BY pay DESC").collect()] == [2, 1, 4, 3]
    assert [r[0] for r in engine.query("SELECT team, COUNT(*) AS n FROM people GROUP BY team ORDER BY n").collect()] == ["y", "x"]
    assert [r[0] for r in engine.query("SELECT team FROM people GROUP BY team ORDER BY COUNT(*) DESC LIMIT 1").collect()] == ["x"]


@pytest.mark.parametrize(
    "text",
    ["SELECT id FROM nowhere;", "SELECT name, COUNT(*) FROM people GROUP BY team;", "SELECT nothing FROM people;", "SELECT id people;", "FROM people;", "SELECT id FROM people", "SELECT id AS a, name AS a FROM people;", "SELECT id FROM people WHERE;", "DROP TABLE nowhere;", "$\"x = 1\";", "SELECT sum(*) FROM people;", "SELECT ? FROM people;"],
)
def test_errors(engine, text):
    with pytest.raises((SqlError, ExpressionError)):
        engine.run(text)


def test_statements(spark, engine, tmp_path):
    data = tmp_path / "t"
    for part, text in (("a", "1\tx\t2.5\n\tw\t\n"), ("b", "3\tz\t1\n")):
        (data / part).mkdir(parents=True)
        (data / part / "f.txt").write_text(text)
    engine.run(f'CREATE TABLE t (n int, s, f float) FROM "{data}"; CREATE TABLE IF NOT EXISTS t (other) FROM "x";')
    assert rows(engine.query("SELECT n, s, f FROM t;")) == sorted([(1, "x", 2.5), (3, "z", 1.0), (None, "w", None)], key=lambda r: (r[0] is None, r[0] or 0))
    assert rows(engine.query('SELECT s FROM t<"b">;')) == [("z",)]
    assert engine.run("SHOW TABLES;") == [["people", "t", "team"]]
    assert engine.run('SHOW TABLES LIKE "t";') == [["t", "team"]]
    assert engine.run("SHOW CREATE TABLE t;") == [f'CREATE TABLE t (n int, s string, f float) FROM "{data}";']
    out = tmp_path / "out"
    engine.run(f'SELECT n, s FROM t WHERE n > 0 INTO OUTFILE "{out}";')
    assert spark.read.csv(str(out)).count() == 2
    engine.run("DROP TABLE t;")
    assert engine.run("SHOW TABLES;") == [["people", "team"]]


def test_compat(spark, people, tmp_path):
    made = Engine(spark, Compat.all())
    made.register("people", people)
    made.register("nulls", spark.createDataFrame([(None, 7, 2), ("a", 9, 2)], "k string, a int, b int"))
    assert rows(made.query("SELECT COUNT(pay) AS n FROM people;")) == [(4,)]
    assert rows(made.query("SELECT a / b AS q FROM nulls;")) == [(3,), (4,)]
    assert made.query("SELECT team, name FROM people GROUP BY team;").count() == 2
    assert made.query("SELECT id FROM people LIMIT 0;").count() == 4
    assert made.query("SELECT x.a AS p, y.a AS q FROM nulls AS x INNER JOIN nulls AS y USING (x.k, y.k);").count() == 2
    (tmp_path / "t.txt").write_text("1,x\n,y\n")
    made.run(f'CREATE TABLE t (n int, s) FROM "{tmp_path / "t.txt"}";')
    assert rows(made.query("SELECT n FROM t;")) == [(0,), (1,)]


def test_python_statements(spark, people):
    made = Engine(spark, allow_python=True)
    made.register("people", people)
    made.run('$"def twice(x): return x * 2";')
    assert rows(made.query("SELECT twice(id) AS t FROM people WHERE id = 2;")) == [(4,)]
    assert rows(made.query('SELECT $"twice(id) + 1" AS t FROM people WHERE id = 2;')) == [(5,)]


def test_plan_of_a_comma_join_is_an_equi_join(spark, engine):
    plan = engine.query("SELECT id FROM people, team WHERE team.code = people.team;")._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan or "SortMergeJoin" in plan
    assert "Cartesian" not in plan
    assert "NestedLoop" not in plan


def test_precedence():
    (s,) = P.parse("SELECT a FROM t WHERE NOT a = 1 AND b = 2 OR c = 3;")
    assert s.where.op == "or"
    assert s.where.left.op == "and"
    assert s.where.left.left.op == "not"


def test_console(engine):
    out = io.StringIO()
    console = Console(engine, out)
    assert console.run("SELECT id, name FROM people WHERE id = 4;")
    assert not console.run("SELECT x FROM people;")
    assert "| 4  | NULL |" in out.getvalue()
    assert "error: " in out.getvalue()
    assert "people" in console.completions("peo")
    assert ascii_table(["a"], [(1,)]).splitlines()[1] == "| a |"
