"""All registered queries against DuckDB, on the smallest tables."""

import datetime
import math

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from millrace.queries import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}" if math.isfinite(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", list(OWN))
def test_query(spark, duck, name):
    df = OWN[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        assert found
        return
    wanted = duck.sql(SQL[name])
    assert sorted(wanted.columns) == columns
    order = [wanted.columns.index(c) for c in columns]
    assert found == sorted(tuple(plain(r[i]) for i in order) for r in wanted.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_need_the_llm_subpackage():
    import pathlib
    import subprocess
    import sys

    root = pathlib.Path(entry.__file__).parent
    code = "import sys; sys.modules['millrace.llm'] = None; import __spark_entry__ as e; assert 'word_count' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    for path in (root / "millrace").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "millrace.llm" not in path.read_text()
