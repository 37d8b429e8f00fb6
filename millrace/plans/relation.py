"""Relations: DataFrames with string expressions, and a clause-style ``execute``.

Aggregates in strings: sum, min, max, avg, count, count(*), last, adcount, group_concat, top. A
column that stands in an aggregate query without one is an error by default; with
``collect_bare=True`` it becomes the list of its values.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import Compiler, ExpressionError
from millrace.operators import joins


def auto_name(text: str) -> str:
    """Name of an unnamed expression: separators and operators become underscores."""
    return re.sub(r"[(, )+*/\-]", "_", text.strip())


def split_alias(text: str) -> tuple[str, str]:
    """Expression and name of ``expr [as name]``."""
    m = re.fullmatch(r"(?is)(.+?)\s+as\s+([A-Za-z_]\w*)", text.strip())
    return (m.group(1), m.group(2)) if m else (text.strip(), auto_name(text))


def split_top(text: str, separator: str = ",") -> list[str]:
    """Split at separators outside brackets and quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == separator and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


class Aggregates:
    """Compiles aggregate calls and remembers whether a bare column stood outside of one."""

    def __init__(self, sequence: Column | None = None):
        self.seen = 0
        self.sequence = sequence if sequence is not None else F.monotonically_increasing_id()

    def __call__(self, name: str, node: ast.Call, compiler: Compiler) -> Column | None:
        star = len(node.args) == 1 and isinstance(node.args[0], ast.Constant) and node.args[0].value == "*"
        known = {"sum", "avg", "count", "adcount", "last", "group_concat", "top", "collect", "first"}
        single_extreme = name in ("min", "max") and len(node.args) == 1
        if name not in known and not single_extreme:
            return None
        self.seen += 1
        if name == "count" and (star or not node.args):
            return F.count(F.lit(1))
        inner = Compiler(list(compiler.fields), None, compiler.resolve)
        if name == "adcount" and star:
            return F.approx_count_distinct(F.struct(*[compiler.resolve(f) for f in sorted(compiler.fields)]))
        args = [inner.visit(a) for a in node.args]
        if name == "group_concat":
            # Listed in input order, joined by commas (or a given separator).
            ordered = F.array_sort(F.collect_list(F.struct(self.sequence.alias("o"), args[0].cast("string").alias("v"))))
            return F.array_join(F.transform(ordered, lambda x: x["v"]), args[1] if len(args) > 1 else ",")
        if name == "last":
            return F.max_by(args[0], self.sequence)
        if name == "first":
            return F.min_by(args[0], self.sequence)
        if name == "top":
            return F.call_function("approx_top_k", args[0], F.lit(20), F.lit(10_000))
        return {"sum": F.sum, "avg": F.avg, "count": F.count, "adcount": F.approx_count_distinct, "min": F.min, "max": F.max, "collect": F.collect_list}[name](args[0])


class Relation:
    """A named DataFrame with string expressions.

    ``sequence`` names the column that gives rows their order, for ``first``, ``last`` and
    ``group_concat``. Without ``sequence`` that is the order in which rows happen to be read.
    """

    def __init__(self, df: DataFrame, name: str = "", sequence: str | None = None, collect_bare: bool = False):
        self.df, self.name, self.sequence, self.collect_bare = df, name, sequence, collect_bare
        if name:
            df.createOrReplaceTempView(name)

    @property
    def fields(self) -> list[str]:
        return self.df.columns

    def _with(self, df: DataFrame) -> Relation:
        return Relation(df, "", self.sequence if self.sequence in df.columns else None, self.collect_bare)

    def _order(self) -> Column | None:
        return F.col(self.sequence) if self.sequence else None

    def _named(self, columns: Sequence[str], named: Mapping[str, str]) -> list[tuple[str, str]]:
        out = []
        for text in columns:
            if not isinstance(text, str):
                raise TypeError("expressions are strings; use a DataFrame for Columns")
            out += [(f, f) for f in self.fields] if text.strip() == "*" else [split_alias(text)]
        out += [(text, name) for name, text in named.items()]
        names = [n for _, n in out]
        if len(set(names)) != len(names):
            raise ExpressionError(f"duplicate output names: {', '.join(sorted({n for n in names if names.count(n) > 1}))}")
        return out

    def select(self, *columns: str, **named: str) -> Relation:
        """Projection; duplicate output names are an error."""
        compiler = Compiler(self.fields)
        return self._with(self.df.select(*[compiler.compile(t).alias(n) for t, n in self._named(columns, named)]))

    def where(self, *conditions: str) -> Relation:
        """Rows for which all conditions hold."""
        df, compiler = self.df, Compiler(self.fields)
        for text in conditions:
            df = df.filter(compiler.compile(text))
        return self._with(df)

    def _aggregate(self, text: str) -> Column:
        calls = Aggregates(self._order())
        prepared = re.sub(r"\(\s*\*\s*\)", "('*')", text)
        column = Compiler(self.fields, calls).compile(prepared)
        if not calls.seen:
            if not self.collect_bare:
                raise ExpressionError(f"{text!r} is neither a key nor an aggregate; say collect({text}) or first({text})")
            column = F.collect_list(column)
        return column

    def group_by(self, keys: str | Sequence[str], *columns: str, **named: str) -> Relation:
        """Keys (expressions) and aggregates."""
        listed = split_top(keys) if isinstance(keys, str) else list(keys)
        compiler = Compiler(self.fields)
        by = [compiler.compile(t).alias(n) for t, n in map(split_alias, listed)]
        aggregates = [self._aggregate(t).alias(n) for t, n in self._named(columns, named)]
        if not aggregates:
            return self._with(self.df.select(*by).distinct())
        return self._with(self.df.groupBy(*by).agg(*aggregates))

    def select_one(self, *columns: str, **named: str) -> Relation:
        """Global aggregates: one row."""
        return self._with(self.df.agg(*[self._aggregate(t).alias(n) for t, n in self._named(columns, named)]))

    def atop(self, field: str, n: int = 20) -> list[tuple]:
        """About the most frequent values with their counts."""
        from millrace.operators.keyed import hot_approx

        return [(r[0], r[1]) for r in hot_approx(self.df, field, n).collect()]

    def index_by(self, keys: str | Sequence[str] | None = None) -> DataFrame:
        """key and value structs: the keys (by default the first field) and the rest."""
        names = self.fields[:1] if keys is None else split_top(keys) if isinstance(keys, str) else list(keys)
        rest = [f for f in self.fields if f not in names]
        return self.df.select(F.struct(*names).alias("key"), F.struct(*rest).alias("value") if rest else F.lit(None).alias("value"))

    def _join(self, other: Relation, kind: str, left_keys, right_keys, broadcast: bool = False) -> Relation:
        left = self.fields and ([f for f in self.fields if f in other.fields] if left_keys is None else split_top(left_keys) if isinstance(left_keys, str) else list(left_keys))
        right = left if right_keys is None else split_top(right_keys) if isinstance(right_keys, str) else list(right_keys)
        if not left or len(left) != len(right):
            raise ExpressionError("a join needs keys, as many on the left as on the right")
        b = other.df
        for k, r in zip(left, right):
            if k != r:
                b = b.withColumnRenamed(r, k)
        made = joins.broadcast_join(self.df, b, left, kind) if broadcast else joins.join(self.df, b, left, kind)
        return self._with(made)

    def join(self, other: Relation, left_keys=None, right_keys=None) -> Relation:
        """Inner join; by default on all common fields. Keys, left rest, right rest."""
        return self._join(other, "inner", left_keys, right_keys)

    def inner_join(self, other: Relation, left_keys=None, right_keys=None) -> Relation:
        """Inner join with a small right side."""
        return self._join(other, "inner", left_keys, right_keys, broadcast=True)

    def left_outer_join(self, other: Relation, left_keys=None, right_keys=None, last_only: bool = False) -> Relation:
        """Left join; ``last_only`` keeps one match a row, the last of the right side."""
        if not last_only:
            return self._join(other, "left", left_keys, right_keys)
        keys = [f for f in self.fields if f in other.fields] if left_keys is None else split_top(left_keys)
        if len(keys) != 1:
            raise ExpressionError("last_only takes a single key")
        return self._with(joins.left_join_last(self.df, other.df, keys[0], other._order() if other.sequence else F.monotonically_increasing_id()))

    def right_outer_join(self, other: Relation, left_keys=None, right_keys=None) -> Relation:
        return self._join(other, "right", left_keys, right_keys)

    def outer_join(self, other: Relation, left_keys=None, right_keys=None) -> Relation:
        return self._join(other, "full", left_keys, right_keys)

    def _sorted(self, fields, reverse: bool) -> list[Column]:
        listed = split_top(fields) if isinstance(fields, str) else list(fields)
        compiler = Compiler(self.fields)
        return [compiler.compile(f).desc_nulls_last() if reverse else compiler.compile(f).asc_nulls_first() for f in listed]

    def sort(self, fields: str | Sequence[str], reverse: bool = False) -> Relation:
        """All fields in one direction."""
        return self._with(self.df.orderBy(*self._sorted(fields, reverse)))

    def top(self, n: int, fields: str | Sequence[str], reverse: bool = False) -> Relation:
        """The ``n`` largest rows (``reverse``: smallest)."""
        return self._with(self.df.orderBy(*self._sorted(fields, not reverse)).limit(n))

    def take(self, n: int):
        return self.df.take(n)

    def collect(self):
        return self.df.collect()

    def save(self, path: str, overwrite: bool = True) -> None:
        """Columnar files that keep the field names."""
        self.df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)

    # --- execute ---

    CLAUSES = ("select", "from", "inner join", "left outer join", "join", "where", "group by", "having", "order by", "limit")

    def execute(self, sql: str, tables: Mapping[str, Relation] | None = None) -> Relation:
        """``select … [from …] [[inner|left outer] join [each] t on a.x = b.y [and …]] [where …]
        [group by … [having …]] [order by … [desc]] [limit n]``; the receiver is the source."""
        part = self._clauses(sql)
        if "select" not in part:
            raise ExpressionError("a query starts with select")
        now = self
        for kind in ("inner join", "left outer join", "join"):
            if kind in part:
                now = now._execute_join(part[kind], kind, tables or {})
        if "where" in part:
            now = now.where(python_condition(part["where"]))
        items = split_top(part["select"])
        if "group by" in part:
            keys = split_top(part["group by"])
            names = [split_alias(k)[1] for k in keys]
            wanted = [split_alias(x) for x in items]
            grouped = now.group_by(keys, **{n: t for t, n in wanted if t not in keys and n not in names})
            if "having" in part:
                grouped = grouped._having(part["having"], wanted)
            source = {t: n for t, n in zip((split_alias(k)[0] for k in keys), names)}
            now = grouped._with(grouped.df.select(*[F.col(f"`{source.get(t, n)}`").alias(n) for t, n in wanted]))
        elif any(self._is_aggregate(split_alias(x)[0]) for x in items):
            now = now.select_one(*items)
        else:
            ordered = now._ordering(part)
            return self._limited(ordered.select(*items) if ordered else now.select(*items), part)
        ordered = now._ordering(part)
        return self._limited(ordered or now, part)

    def _is_aggregate(self, text: str) -> bool:
        calls = Aggregates()
        Compiler(self.fields, calls, lambda n: F.col(f"`{n}`"))
        try:
            tree = ast.parse(re.sub(r"\(\s*\*\s*\)", "('*')", text.strip()), mode="eval")
        except SyntaxError as error:
            raise ExpressionError(f"not an expression: {text!r}") from error
        names = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
        single = any(isinstance(n, ast.Call) and getattr(n.func, "id", "") in ("min", "max") and len(n.args) == 1 for n in ast.walk(tree))
        return single or bool(names & {"sum", "avg", "count", "adcount", "last", "group_concat", "top", "collect", "first"})

    def _clauses(self, sql: str) -> dict[str, str]:
        pattern = r"(?i)\b(" + "|".join(c.replace(" ", r"\s+") for c in self.CLAUSES) + r")\b"
        masked = re.sub(r"\"[^\"]*\"|'[^']*'", lambda m: "\0" * len(m.group()), sql)
        found = list(re.finditer(pattern, masked))
        out: dict[str, str] = {}
        for m, after in zip(found, [*found[1:], None]):
            clause = " ".join(m.group(1).lower().split())
            if clause in out:
                raise ExpressionError(f"clause given twice: {clause}")
            out[clause] = sql[m.end() : after.start() if after else len(sql)].strip().rstrip(";").strip()
        return out

    def _execute_join(self, text: str, kind: str, tables: Mapping[str, Relation]) -> Relation:
        m = re.fullmatch(r"(?is)(?:each\s+)?(\w+)\s+on\s+(.+)", text)
        if not m:
            raise ExpressionError(f"not a join: {text!r}")
        name = m.group(1)
        other = tables[name] if name in tables else Relation(self.df.sparkSession.table(name))
        left, right = [], []
        for pair in re.split(r"(?i)\s+and\s+", m.group(2)):
            a, b = (x.strip() for x in re.split(r"==?", pair))
            table_a, column_a = a.rpartition(".")[::2]
            column_b = b.rpartition(".")[2]
            if table_a == name:
                column_a, column_b = column_b, column_a
            left.append(column_a)
            right.append(column_b)
        return self._join(other, "left" if kind.startswith("left") else "inner", left, right)

    def _having(self, text: str, wanted: Sequence[tuple[str, str]]) -> Relation:
        for expression, name in sorted(wanted, key=lambda x: -len(x[0])):
            text = text.replace(expression, name) if expression != name and "(" in expression else text
        return self.where(python_condition(text))

    def _ordering(self, part: Mapping[str, str]) -> Relation | None:
        if "order by" not in part:
            return None
        m = re.fullmatch(r"(?is)(.+?)(?:\s+(asc|desc))?", part["order by"])
        return self.sort(m.group(1), (m.group(2) or "").lower() == "desc")

    @staticmethod
    def _limited(made: Relation, part: Mapping[str, str]) -> Relation:
        return made._with(made.df.limit(int(part["limit"]))) if "limit" in part else made


def python_condition(text: str) -> str:
    """A condition with SQL's ``=``, ``<>``, ``AND``, ``OR``, ``NOT`` as an expression string."""
    out = []
    for piece in re.split(r"(\"[^\"]*\"|'[^']*')", text):
        if piece[:1] not in "\"'" or not piece:
            piece = re.sub(r"<>", "!=", piece)
            piece = re.sub(r"(?<![<>=!])=(?!=)", "==", piece)
            piece = re.sub(r"(?i)\b(and|or|not|in|is)\b", lambda m: m.group().lower(), piece)
            piece = re.sub(r"(?i)\bnull\b", "None", piece)
        out.append(piece)
    return "".join(out)


def as_table(df: DataFrame, fields: str | Sequence[str] | None = None, name: str = "", **options) -> Relation:
    """A relation over ``df``, its columns renamed to ``fields`` (a list, or names with commas)."""
    names = None if fields is None else [f.strip() for f in fields.split(",")] if isinstance(fields, str) else list(fields)
    return Relation(df.toDF(*names) if names else df, name, **options)
