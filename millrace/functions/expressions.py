"""Expression strings compiled to Columns.

The language is a whitelisted part of Python's expression grammar, read with ``ast`` and never
evaluated: names, literals, arithmetic, comparisons, ``and``/``or``/``not``, ``in``, ``is None``,
conditional expressions, subscripts and slices, calls of known functions and string methods.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.hashing import fnv1a


class ExpressionError(ValueError):
    """The text is not an expression that can be compiled."""


def _py_round(x: Column, digits: Column | None = None) -> Column:
    return F.round(x) if digits is None else F.round(x, digits)


#: Functions of one or more Columns, among them what Python's ``math`` offers.
SCALARS: dict[str, Callable[..., Column]] = {
    "sqrt": F.sqrt, "exp": F.exp, "expm1": F.expm1, "log10": F.log10, "log1p": F.log1p, "log2": F.log2,
    "pow": F.pow, "ceil": F.ceil, "floor": F.floor, "fabs": F.abs, "abs": F.abs, "sin": F.sin, "cos": F.cos,
    "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2, "sinh": F.sinh,
    "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "degrees": F.degrees, "radians": F.radians, "hypot": F.hypot, "factorial": F.factorial, "isnan": F.isnan,
    "log": lambda x, base=None: F.ln(x) if base is None else F.ln(x) / F.ln(base),
    "fmod": lambda x, y: x % y,
    "trunc": lambda x: x.cast("bigint"),
    "copysign": lambda x, y: F.abs(x) * F.when(F.signum(y) < 0, -1).otherwise(1),
    "ldexp": lambda x, i: x * F.pow(F.lit(2.0), i),
    "isinf": lambda x: F.abs(x) == float("inf"),
    "int": lambda x: x.cast("bigint"), "float": lambda x: x.cast("double"), "str": lambda x: x.cast("string"),
    "bool": lambda x: x.cast("boolean"), "len": F.length, "round": _py_round,
    "min": F.least, "max": F.greatest, "coalesce": F.coalesce,
    "lower": F.lower, "upper": F.upper, "concat": F.concat, "hash": F.hash, "crc32": F.crc32,
    "dict": F.map_from_arrays, "sorted": F.array_sort, "size": F.size, "fnv1a": fnv1a,
    "rmatch": lambda x, p: F.rlike(x, F.concat(F.lit("^(?:"), p, F.lit(")"))),
}

#: Methods of strings, arrays and maps.
METHODS: dict[str, Callable[..., Column]] = {
    "lower": F.lower, "upper": F.upper, "title": F.initcap,
    "strip": lambda s, chars=None: F.trim(s) if chars is None else F.btrim(s, chars),
    "lstrip": lambda s, chars=None: F.ltrim(s) if chars is None else F.ltrim(s, chars),
    "rstrip": lambda s, chars=None: F.rtrim(s) if chars is None else F.rtrim(s, chars),
    "startswith": F.startswith, "endswith": F.endswith,
    "replace": F.replace,
    "keys": F.map_keys, "values": F.map_values, "items": F.map_entries,
    "get": lambda m, k, other=None: F.try_element_at(m, k) if other is None else F.coalesce(F.try_element_at(m, k), other),
    "index": lambda a, v: F.array_position(a, v) - 1, "count": lambda a, v: F.size(F.filter(a, lambda x: x == v)), 
    "join": lambda sep, a: F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.coalesce(F.get(a, F.lit(0)), F.lit("")), lambda s, v: F.concat(s, sep, v)),
    "find": lambda s, part: F.instr(s, part) - 1,
    "split": lambda s, sep=None: F.split(F.trim(s), r"\s+") if sep is None else F.split(s, F.concat(F.lit(r"\Q"), sep, F.lit(r"\E"))),
}

CONSTANTS = {"pi": math.pi, "e": math.e, "True": True, "False": False, "None": None}

_BINARY = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b),
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)), ast.Pow: F.pow,
    ast.BitAnd: lambda a, b: a.bitwiseAND(b), ast.BitOr: lambda a, b: a.bitwiseOR(b), ast.BitXor: lambda a, b: a.bitwiseXOR(b),
    ast.Mod: lambda a, b: F.try_mod(F.try_mod(a, b) + b, b),
}
_COMPARE = {
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
}


class Compiler:
    """Compiles expressions over given fields.

    ``calls`` may handle further functions (aggregates); it gets the name, the compiled arguments
    and the syntax node, and returns a Column or None.
    """

    def __init__(self, fields: list[str], calls: Callable | None = None, resolve: Callable[[str], Column] | None = None):
        self.fields, self.calls = set(fields), calls
        self.resolve = resolve or (lambda name: F.col(f"`{name}`"))

    def compile(self, text: str) -> Column:
        try:
            tree = ast.parse(text.strip(), mode="eval")
        except SyntaxError as error:
            raise ExpressionError(f"not an expression: {text!r}") from error
        return self.visit(tree.body)

    def strings(self, node: ast.AST) -> bool:
        """Whether a node is known to be text, so that ``+`` joins."""
        if isinstance(node, ast.Constant):
            return isinstance(node.value, str)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            return self.strings(node.left) or self.strings(node.right)
        if isinstance(node, ast.Call):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
            return name in ("str", "lower", "upper", "strip", "lstrip", "rstrip", "replace", "title", "concat")
        return False

    def visit(self, node: ast.AST) -> Column:
        if isinstance(node, ast.Constant):
            if node.value is None or isinstance(node.value, (bool, int, float, str)):
                return F.lit(node.value)
        elif isinstance(node, ast.Name):
            if node.id in self.fields:
                return self.resolve(node.id)
            if node.id in CONSTANTS:
                return F.lit(CONSTANTS[node.id])
            raise ExpressionError(f"no such field: {node.id}")
        elif isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            left, right = self.visit(node.left), self.visit(node.right)
            if isinstance(node.op, ast.Add) and self.strings(node):
                return F.concat(left, right)
            return _BINARY[type(node.op)](left, right)
        elif isinstance(node, ast.UnaryOp):
            value = self.visit(node.operand)
            if isinstance(node.op, ast.Not):
                return ~value
            if isinstance(node.op, ast.USub):
                return -value
            if isinstance(node.op, ast.UAdd):
                return value
        elif isinstance(node, ast.BoolOp):
            values = [self.visit(v) for v in node.values]
            out = values[0]
            for v in values[1:]:
                out = (out & v) if isinstance(node.op, ast.And) else (out | v)
            return out
        elif isinstance(node, ast.Compare):
            return self.comparison(node)
        elif isinstance(node, ast.IfExp):
            return F.when(self.visit(node.test), self.visit(node.body)).otherwise(self.visit(node.orelse))
        elif isinstance(node, ast.Subscript):
            return self.subscript(node)
        elif isinstance(node, ast.Attribute):
            qualified = ast.unparse(node)
            if qualified in self.fields:
                return self.resolve(qualified)
            if isinstance(node.value, ast.Name) and node.value.id == "math" and node.attr in CONSTANTS:
                return F.lit(CONSTANTS[node.attr])
        elif isinstance(node, ast.Call) and not node.keywords:
            return self.call(node)
        raise ExpressionError(f"not supported in expressions: {ast.unparse(node)!r}")

    def comparison(self, node: ast.Compare) -> Column:
        out, left = None, node.left
        for op, right in zip(node.ops, node.comparators):
            if isinstance(op, (ast.In, ast.NotIn)):
                if isinstance(right, (ast.Tuple, ast.List, ast.Set)):
                    one = self.visit(left).isin(*[self.visit(x) for x in right.elts])
                else:
                    one = F.contains(self.visit(right), self.visit(left))
                one = ~one if isinstance(op, ast.NotIn) else one
            elif isinstance(op, (ast.Is, ast.IsNot)) and isinstance(right, ast.Constant) and right.value is None:
                one = self.visit(left).isNull() if isinstance(op, ast.Is) else self.visit(left).isNotNull()
            elif isinstance(op, (ast.Eq, ast.NotEq)) and isinstance(right, ast.Constant) and right.value is None:
                one = self.visit(left).isNull() if isinstance(op, ast.Eq) else self.visit(left).isNotNull()
            elif type(op) in _COMPARE:
                one = _COMPARE[type(op)](self.visit(left), self.visit(right))
            else:
                raise ExpressionError(f"not supported in expressions: {ast.unparse(node)!r}")
            out, left = one if out is None else out & one, right
        return out

    def subscript(self, node: ast.Subscript) -> Column:
        value = self.visit(node.value)
        if isinstance(node.slice, ast.Slice):
            if node.slice.step is not None:
                raise ExpressionError("a slice takes no step")
            start = self.visit(node.slice.lower) if node.slice.lower else F.lit(0)
            begin = F.when(start < 0, F.greatest(F.length(value) + start, F.lit(0))).otherwise(start)
            if node.slice.upper is None:
                return F.substring(value, begin + 1, F.length(value))
            stop = self.visit(node.slice.upper)
            end = F.when(stop < 0, F.length(value) + stop).otherwise(stop)
            return F.substring(value, begin + 1, F.greatest(end - begin, F.lit(0)))
        index = self.visit(node.slice)
        if isinstance(node.value, ast.Call):  # the elements of a split
            return F.get(value, F.when(index < 0, F.size(value) + index).otherwise(index))
        return value[index]

    def call(self, node: ast.Call) -> Column:
        if isinstance(node.func, ast.Name):
            name = node.func.id
            if self.calls and (made := self.calls(name, node, self)) is not None:
                return made
            if name in SCALARS:
                return SCALARS[name](*[self.visit(a) for a in node.args])
            raise ExpressionError(f"no such function: {name}")
        if isinstance(node.func, ast.Attribute):
            if isinstance(node.func.value, ast.Name) and node.func.value.id == "math" and "math" not in self.fields and node.func.attr in SCALARS:
                return SCALARS[node.func.attr](*[self.visit(a) for a in node.args])
            if node.func.attr in METHODS:
                return METHODS[node.func.attr](self.visit(node.func.value), *[self.visit(a) for a in node.args])
        raise ExpressionError(f"no such function: {ast.unparse(node.func)}")


def expression(text: str, fields: list[str]) -> Column:
    """A scalar expression over ``fields`` as a Column."""
    return Compiler(fields).compile(text)
