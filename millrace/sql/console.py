"""A small SQL console: ``python -m millrace.sql.console [-e SQL | -s FILE] [--compat]``.

Without -e or -s it reads statements interactively, with history and completion of names where
readline is present. Statements end with ``;``.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame

from millrace.session import build_session
from millrace.sql.engine import Compat, Engine
from millrace.sql.parser import AGGREGATES, KEYWORDS, SqlError


def ascii_table(columns: list[str], rows: list[tuple]) -> str:
    """Rows under their column names, in a frame of characters."""
    cells = [[("NULL" if v is None else str(v)) for v in r] for r in rows]
    widths = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(columns)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda r: "|" + "|".join(f" {v.ljust(w)} " for v, w in zip(r, widths)) + "|"
    return "\n".join([rule, line(columns), rule, *map(line, cells), rule])


def shown(result, limit: int = 1000) -> str:
    if isinstance(result, DataFrame):
        rows = result.take(limit + 1)
        more = f"\n(the first {limit} rows)" if len(rows) > limit else ""
        return ascii_table(result.columns, [tuple(r) for r in rows[:limit]]) + more
    if isinstance(result, list):
        return ascii_table(["table"], [(x,) for x in result])
    return str(result) if result is not None else "done"


class Console:
    def __init__(self, engine: Engine, out=None):
        self.engine, self.out = engine, out or sys.stdout

    def run(self, script: str) -> bool:
        """Run all statements; False after an error, which is printed."""
        try:
            for result in self.engine.run(script):
                print(shown(result), file=self.out)
            return True
        except SqlError as error:
            print(f"error: {error}", file=self.out)
            return False

    def completions(self, prefix: str) -> list[str]:
        tables = self.engine.tables
        names = {*KEYWORDS, *AGGREGATES, *tables, *(c for t in tables.values() for c, _ in t.columns)}
        return sorted(n for n in names if n.lower().startswith(prefix.lower()))

    def loop(self) -> None:
        try:
            import readline

            readline.parse_and_bind("tab: complete")
            readline.set_completer(lambda text, i: dict(enumerate(self.completions(text))).get(i))
        except ImportError:
            pass
        held = ""
        while True:
            try:
                line = input("sql> " if not held else "...> ")
            except EOFError:
                return
            if not held and line.strip().lower() in ("quit", "exit"):
                return
            held += line + "\n"
            if held.rstrip().endswith(";"):
                self.run(held)
                held = ""


def main(argv: list[str] | None = None) -> int:
    options = argparse.ArgumentParser(prog="millrace.sql.console")
    options.add_argument("-e", metavar="SQL", help="run a text")
    options.add_argument("-s", metavar="FILE", help="run a script")
    options.add_argument("--compat", action="store_true", help="the dialect's historical semantics")
    given = options.parse_args(argv)
    console = Console(Engine(build_session("sql"), Compat.all() if given.compat else None))
    if given.e is not None:
        return 0 if console.run(given.e if given.e.rstrip().endswith(";") else given.e + ";") else 1
    if given.s is not None:
        with open(given.s, encoding="utf-8") as script:
            return 0 if console.run(script.read()) else 1
    console.loop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
