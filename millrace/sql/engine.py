"""Statements of the compact SQL dialect turned into DataFrames.

The tree is compiled to Columns; Catalyst does the rest (a comma list with an equality in WHERE
becomes a join, selectors become path filters, LIMIT is pushed down).

Standard semantics are the default; ``Compat`` switches on the dialect's historical ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.expressions import SCALARS, Compiler
from millrace.sql import parser as P
from millrace.sql.parser import SqlError


@dataclass(frozen=True)
class Compat:
    """Historical semantics, each off by default.

    empty_as_zero: an empty text in a numeric column is 0, not NULL; int_division: ``/`` of two
    integers floors; count_nulls: COUNT(e) counts NULLs, and COUNT(DISTINCT e) takes NULL as a
    value; first_row: a column that is neither grouped nor aggregated takes some row's value;
    null_keys_match: NULL keys join each other; limit_zero_is_all: LIMIT 0 returns all rows.
    """

    empty_as_zero: bool = False
    int_division: bool = False
    count_nulls: bool = False
    first_row: bool = False
    null_keys_match: bool = False
    limit_zero_is_all: bool = False

    @classmethod
    def all(cls) -> Compat:
        return cls(*[True] * 6)


@dataclass(frozen=True)
class Defined:
    """A catalogue entry."""

    name: str
    columns: tuple[tuple[str, str], ...]
    path: str
    expression: str | None
    frame: DataFrame | None = None


def guess_separator(spark: SparkSession, path: str) -> str:
    """Tab, comma or space: whichever the first row has, in that order of preference."""
    row = spark.read.option("recursiveFileLookup", True).text(path).head()
    line = row[0] if row else ""
    return "\t" if "\t" in line else "," if "," in line else " "


class Scope:
    """Columns that names may refer to: qualified and, where they are unambiguous, bare."""

    def __init__(self, frame: DataFrame, names: dict[str, str]):
        self.frame, self.names = frame, names

    def column(self, name: str) -> Column:
        if name not in self.names:
            raise SqlError(f"no such column, or an ambiguous one: {name}")
        return F.col(f"`{self.names[name]}`")


class Engine:
    """A catalogue of tables and the statements over it.

    ``allow_python`` admits ``$"statement"`` that define functions of Columns; they run in this
    process, so only give it trusted text. Expressions ``$"…"`` are compiled, never evaluated.
    """

    def __init__(self, spark: SparkSession, compat: Compat | None = None, allow_python: bool = False):
        self.spark, self.compat, self.allow_python = spark, compat or Compat(), allow_python
        self.tables: dict[str, Defined] = {}
        self.functions: dict[str, object] = {}

    # --- statements ---

    def register(self, name: str, frame: DataFrame) -> None:
        """Offer a DataFrame as a table."""
        self.tables[name] = Defined(name, tuple(frame.dtypes), "", None, frame)

    def run(self, script: str) -> list:
        """Results of all statements: a DataFrame, a list or None for each."""
        return [self.execute(s) for s in P.parse(script)]

    def query(self, text: str) -> DataFrame:
        """The DataFrame of a single SELECT (the closing ``;`` may be missing)."""
        statements = P.parse(text if text.rstrip().endswith(";") else text + ";")
        if len(statements) != 1 or not isinstance(statements[0], P.Select):
            raise SqlError("expected one SELECT")
        return self.execute(statements[0])

    def execute(self, statement):
        if isinstance(statement, P.Select):
            return self.select(statement)
        if isinstance(statement, P.CreateTable):
            if statement.name in self.tables and statement.if_not_exists:
                return None
            names = [n for n, _ in statement.columns]
            if len(set(names)) != len(names):
                raise SqlError("a column is declared twice")
            self.tables[statement.name] = Defined(statement.name, statement.columns, statement.path, statement.expression)
            return None
        if isinstance(statement, P.DropTable):
            missing = [n for n in statement.names if n not in self.tables]
            if missing:
                raise SqlError(f"no such table: {', '.join(missing)}")
            for n in statement.names:
                del self.tables[n]
            return None
        if isinstance(statement, P.ShowTables):
            return [n for n in sorted(self.tables) if statement.pattern is None or re.match(statement.pattern, n)]
        if isinstance(statement, P.ShowCreate):
            return self.definition(statement.name)
        if isinstance(statement, P.PythonStatement):
            return self.python(statement.text)
        raise SqlError("not a statement")

    def definition(self, name: str) -> str:
        """Text that creates the table."""
        t = self.table(name)
        kinds = {"bigint": "int", "int": "int", "double": "float", "float": "float"}
        columns = ", ".join(f"{c} {kinds.get(k, 'string')}" for c, k in t.columns)
        quoted = t.path.replace("\\", "\\\\").replace('"', '\\"')
        tail = ' $"' + t.expression.replace("\\", "\\\\").replace('"', '\\"') + '"' if t.expression else ""
        return f'CREATE TABLE {t.name} ({columns}) FROM "{quoted}"{tail};'

    def python(self, text: str) -> None:
        if not self.allow_python:
            raise SqlError("Python statements are switched off; they need Engine(allow_python=True)")
        made: dict = {"F": F}
        exec(text, made)  # trusted text only, as the flag's documentation says
        self.functions |= {k: v for k, v in made.items() if callable(v) and not k.startswith("_") and k != "F"}

    def table(self, name: str) -> Defined:
        if name not in self.tables:
            raise SqlError(f"no such table: {name}")
        return self.tables[name]

    # --- sources ---

    def scan(self, source: P.Table) -> DataFrame:
        t = self.table(source.name)
        if t.frame is not None:
            return t.frame
        paths = [f"{t.path.rstrip('/')}/{g}" for g in source.selectors] or [t.path]
        if t.path.rstrip("/").endswith(".parquet") and not source.selectors:
            read = self.spark.read.parquet(t.path)
            return read.select(*[F.col(a).alias(c) for a, (c, _) in zip(read.columns, t.columns)])
        separator = guess_separator(self.spark, paths[0])
        raw = T.StructType([T.StructField(c, T.StringType()) for c, _ in t.columns])
        read = self.spark.read.schema(raw).option("sep", separator).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("emptyValue", "").option("nullValue", "\0").csv(paths)
        made = read.select(*[self.converted(F.col(f"`{c}`"), kind).alias(c) for c, kind in t.columns])
        return made.filter(Compiler([c for c, _ in t.columns]).compile(t.expression)) if t.expression else made

    def converted(self, text: Column, kind: str) -> Column:
        if kind == "string":
            return text
        number = F.trim(text).try_cast(kind)
        return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0).cast(kind)).otherwise(number) if self.compat.empty_as_zero else number

    def scope(self, source) -> Scope:
        if isinstance(source, P.Table):
            return self.named(self.scan(source), source.alias or source.name, source.alias is not None)
        if isinstance(source, P.Subquery):
            return self.named(self.select(source.query), source.alias, True)
        if isinstance(source, P.Cartesian):
            scopes = [self.prefixed(self.scope(s), i) for i, s in enumerate(source.sources)]
            frame = scopes[0].frame
            for s in scopes[1:]:
                frame = frame.crossJoin(s.frame)
            return Scope(frame, self.merged(scopes))
        if isinstance(source, P.Join):
            left, right = self.prefixed(self.scope(source.left), 0), self.prefixed(self.scope(source.right), 1)
            a, b = left.column(source.left_key), right.column(source.right_key)
            same = a.eqNullSafe(b) if self.compat.null_keys_match else a == b
            return Scope(left.frame.join(right.frame, same, source.kind), self.merged([left, right]))
        raise SqlError("not a source")

    @staticmethod
    def named(frame: DataFrame, alias: str, only_alias: bool) -> Scope:
        names = {f"{alias}.{c}": c for c in frame.columns}
        return Scope(frame, names | {c: c for c in frame.columns} if not only_alias else names | {c: c for c in frame.columns})

    @staticmethod
    def prefixed(scope: Scope, i: int) -> Scope:
        """Columns renamed so that two sides never clash."""
        frame = scope.frame.select(*[F.col(f"`{c}`").alias(f"{i}_{c}") for c in scope.frame.columns])
        return Scope(frame, {n: f"{i}_{c}" for n, c in scope.names.items()})

    @staticmethod
    def merged(scopes: list[Scope]) -> dict[str, str]:
        every: dict[str, list[str]] = {}
        for s in scopes:
            for n, c in s.names.items():
                every.setdefault(n, []).append(c)
        return {n: c[0] for n, c in every.items() if len(c) == 1}

    # --- expressions ---

    def compiled(self, node, scope: Scope, known: dict[str, Column] | None = None) -> Column:
        """A Column for a scalar expression; ``known`` are aliases that may be used."""
        if isinstance(node, P.Literal):
            return F.lit(node.value)
        if isinstance(node, P.Name):
            return known[node.value] if known and node.value in known else scope.column(node.value)
        if isinstance(node, P.Python):
            names = dict(scope.names)
            resolve = lambda n: known[n] if known and n in known else F.col(f"`{names[n]}`")
            return Compiler([*names, *(known or {})], self.python_call, resolve).compile(node.text)
        if isinstance(node, P.Unary):
            value = self.compiled(node.value, scope, known)
            return {"not": lambda: ~value, "-": lambda: -value, "isnull": value.isNull, "notnull": value.isNotNull}[node.op]()
        if isinstance(node, P.In):
            made = self.compiled(node.value, scope, known).isin(*[self.compiled(o, scope, known) for o in node.options])
            return ~made if node.negated else made
        if isinstance(node, P.Call):
            if node.name in P.AGGREGATES:
                return self.aggregate(node, scope)
            args = [self.compiled(a, scope, known) for a in node.args]
            function = self.functions.get(node.name) or SCALARS.get(node.name)
            if function is None:
                raise SqlError(f"no such function: {node.name}")
            return function(*args)
        if isinstance(node, P.Binary):
            return self.binary(node, scope, known)
        raise SqlError("* stands only alone or in COUNT and ADCOUNT")

    def binary(self, node: P.Binary, scope: Scope, known) -> Column:
        a, b = self.compiled(node.left, scope, known), self.compiled(node.right, scope, known)
        if node.op == "like":
            return F.rlike(a.cast("string"), F.concat(F.lit("^(?:"), b, F.lit(")")))
        if node.op == "/":
            if self.compat.int_division and self.kind(node.left, scope) == self.kind(node.right, scope) == "int":
                return F.floor(F.try_divide(a, b)).cast("bigint")
            return F.try_divide(a.cast("double"), b)
        if node.op == "+" and "string" in (self.kind(node.left, scope), self.kind(node.right, scope)):
            return F.concat(a.cast("string"), b.cast("string"))
        return {
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: F.try_mod(a, b),
            "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b,
            "<=": lambda: a <= b, ">=": lambda: a >= b, "and": lambda: a & b, "or": lambda: a | b,
        }[node.op]()

    def kind(self, node, scope: Scope) -> str:
        """int, float, string or other, as far as the tree tells."""
        if isinstance(node, P.Literal):
            return "string" if isinstance(node.value, str) else "float"
        if isinstance(node, P.Name) and node.value in scope.names:
            written = dict(scope.frame.dtypes)[scope.names[node.value]]
            return {"string": "string", "bigint": "int", "int": "int", "smallint": "int", "double": "float", "float": "float"}.get(written, "other")
        if isinstance(node, P.Binary):
            kinds = {self.kind(node.left, scope), self.kind(node.right, scope)}
            return "string" if "string" in kinds else "int" if kinds == {"int"} else "float"
        return "other"

    def python_call(self, name: str, node, compiler: Compiler) -> Column | None:
        return self.functions[name](*[compiler.visit(a) for a in node.args]) if name in self.functions else None

    def aggregate(self, node: P.Call, scope: Scope) -> Column:
        if len(node.args) != 1:
            raise SqlError(f"{node.name} takes one argument")
        if isinstance(node.args[0], P.Star):
            if node.name == "count":
                return F.count(F.lit(1))
            if node.name == "adcount":
                return F.approx_count_distinct(F.struct(*[F.col(f"`{c}`") for c in scope.frame.columns]))
            raise SqlError(f"{node.name}(*) means nothing")
        value = self.compiled(node.args[0], scope)
        if node.name == "count":
            if self.compat.count_nulls:
                return F.count_distinct(F.struct(value)) if node.distinct else F.count(F.lit(1))
            return F.count_distinct(value) if node.distinct else F.count(value)
        if node.name == "sum":
            return F.sum_distinct(value) if node.distinct else F.sum(value)
        if node.name == "avg":
            if node.distinct:
                return F.sum_distinct(value).cast("double") / F.count_distinct(value)
            return F.avg(value)
        return {"max": F.max, "min": F.min, "adcount": F.approx_count_distinct}[node.name](value)

    # --- select ---

    def contains_aggregate(self, node) -> bool:
        if isinstance(node, P.Call):
            return node.name in P.AGGREGATES or any(map(self.contains_aggregate, node.args))
        parts = [getattr(node, k) for k in ("value", "left", "right") if hasattr(node, k)]
        return any(self.contains_aggregate(p) for p in parts if not isinstance(p, (str, float, int, type(None))))

    @staticmethod
    def label(item: P.Item, i: int) -> str:
        if item.alias:
            return item.alias
        if isinstance(item.value, P.Name):
            return item.value.value.rpartition(".")[2]
        if isinstance(item.value, P.Call):
            inner = "*" if item.value.args and isinstance(item.value.args[0], P.Star) else ", ".join(a.value if isinstance(a, P.Name) else "…" for a in item.value.args)
            return f"{item.value.name}({'distinct ' if item.value.distinct else ''}{inner})"
        return f"c{i}"

    def select(self, s: P.Select) -> DataFrame:
        scope = self.scope(s.source)
        frame = scope.frame.filter(self.compiled(s.where, scope)) if s.where else scope.frame
        scope = Scope(frame, scope.names)
        star = len(s.items) == 1 and isinstance(s.items[0].value, P.Star)
        if star and not s.group:
            shown = list(dict.fromkeys(scope.names.values()))
            outward = {}
            for n, c in scope.names.items():
                if c not in outward or "." not in n:
                    outward[c] = n
            items = [(F.col(f"`{c}`"), outward[c]) for c in shown]
            known = {n: F.col(f"`{scope.names[n]}`") for n in scope.names}
            made = self.ordered(frame, s, scope, known)
            return self.finished(made.select(*[c.alias(n) for c, n in items]), s)
        labels = [self.label(x, i) for i, x in enumerate(s.items)]
        if len(set(labels)) != len(labels):
            raise SqlError(f"duplicate output names: {', '.join(labels)}")
        if s.group or any(self.contains_aggregate(x.value) for x in s.items):
            return self.grouped(s, scope, labels)
        values = {n: self.compiled(x.value, scope) for n, x in zip(labels, s.items)}
        made = self.ordered(frame, s, scope, values)
        return self.finished(made.select(*[c.alias(n) for n, c in values.items()]), s)

    def grouped(self, s: P.Select, scope: Scope, labels: list[str]) -> DataFrame:
        aliases = {x.alias: x.value for x in s.items if x.alias}
        keys = [aliases.get(g.value, g) if isinstance(g, P.Name) and g.value not in scope.names else g for g in s.group]
        by = [self.compiled(k, scope).alias(f"__k{i}") for i, k in enumerate(keys)]
        aggregates, shown = [], {}

        def outer(node, label: str) -> Column:
            """The Column over the grouped frame."""
            if node in keys:
                return F.col(f"__k{keys.index(node)}")
            if isinstance(node, P.Call) and node.name in P.AGGREGATES:
                name = f"__a{len(aggregates)}"
                aggregates.append(self.aggregate(node, scope).alias(name))
                return F.col(name)
            if self.contains_aggregate(node):
                if isinstance(node, P.Binary):
                    inner = Scope(scope.frame, scope.names)
                    left, right = outer(node.left, label), outer(node.right, label)
                    return self.over(node, left, right, inner)
                if isinstance(node, P.Unary):
                    value = outer(node.value, label)
                    return -value if node.op == "-" else ~value
            if isinstance(node, (P.Literal,)):
                return F.lit(node.value)
            if self.compat.first_row:
                name = f"__a{len(aggregates)}"
                aggregates.append(F.any_value(self.compiled(node, scope)).alias(name))
                return F.col(name)
            raise SqlError(f"{label} is neither grouped nor aggregated")

        for x, label in zip(s.items, labels):
            shown[label] = outer(x.value, label)
        having = self.hidden(s.having, outer) if s.having is not None else None
        orders = [(self.hidden(e, outer), d) for e, d in s.order]
        frame = scope.frame.groupBy(*by).agg(*aggregates) if aggregates else scope.frame.select(*by).distinct()
        made = Scope(frame, {})
        if having is not None:
            frame = frame.filter(self.resolved(having, made, shown))
        if orders:
            frame = frame.orderBy(*[self.direction(self.resolved(e, made, shown), d) for e, d in orders])
        return self.finished(frame.select(*[c.alias(n) for n, c in shown.items()]), s)

    def hidden(self, node, outer):
        """The condition with its aggregates already placed in the grouped frame."""
        if isinstance(node, P.Call) and node.name in P.AGGREGATES:
            return outer(node, node.name)
        if isinstance(node, P.Binary):
            return P.Binary(node.op, self.hidden(node.left, outer), self.hidden(node.right, outer))
        if isinstance(node, P.Unary):
            return P.Unary(node.op, self.hidden(node.value, outer))
        if isinstance(node, P.In):
            return P.In(self.hidden(node.value, outer), node.options, node.negated)
        return node

    def resolved(self, node, scope: Scope, shown: dict[str, Column]) -> Column:
        if isinstance(node, Column):
            return node
        if isinstance(node, P.Binary):
            return self.over(node, self.resolved(node.left, scope, shown), self.resolved(node.right, scope, shown), scope)
        if isinstance(node, P.Unary):
            value = self.resolved(node.value, scope, shown)
            return {"not": lambda: ~value, "-": lambda: -value, "isnull": value.isNull, "notnull": value.isNotNull}[node.op]()
        if isinstance(node, P.In):
            made = self.resolved(node.value, scope, shown).isin(*[self.resolved(o, scope, shown) for o in node.options])
            return ~made if node.negated else made
        return self.compiled(node, scope, shown)

    def over(self, node: P.Binary, left: Column, right: Column, scope: Scope) -> Column:
        """A binary operation on Columns that are made already."""
        known = {"\0l": left, "\0r": right}
        return self.binary(P.Binary(node.op, P.Name("\0l"), P.Name("\0r")), scope, known)

    def ordered(self, frame: DataFrame, s: P.Select, scope: Scope, known: dict[str, Column]) -> DataFrame:
        if not s.order:
            return frame
        return frame.orderBy(*[self.direction(self.compiled(e, scope, known), d) for e, d in s.order])

    @staticmethod
    def direction(column: Column, descending: bool) -> Column:
        return column.desc_nulls_last() if descending else column.asc_nulls_first()

    def finished(self, frame: DataFrame, s: P.Select) -> DataFrame:
        limited = s.limit is not None and not (s.limit == 0 and self.compat.limit_zero_is_all)
        if limited:
            frame = frame.limit(s.limit)
        if s.outfile:
            (frame.coalesce(1) if limited else frame).write.mode("overwrite").csv(s.outfile)
        return frame
