"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import datetime as dt
import glob
import importlib
import math
import sys
from pathlib import Path

import duckdb
import pytest

from docloom.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(small_tables):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{small_tables}/*.parquet"):
        c.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return c


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v) if v is None or not isinstance(v, int) or isinstance(v, bool) else repr(float(v))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, small_tables, con, name):
    got = QUERIES[name](spark, small_tables)
    names = sorted(got.columns)
    rows = sorted(tuple(map(cell, r)) for r in got.select(*names).collect())
    assert rows
    if name not in SQL:  # see test_whole_queries
        return
    truth = con.sql(SQL[name])
    assert sorted(truth.columns) == names
    assert sorted(tuple(map(cell, r)) for r in truth.select(*[f'"{n}"' for n in names]).fetchall()) == rows


def test_entry_works_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("docloom.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("docloom.llm", "docloom.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) == set(entry.queries()) and set(SQL) == set(entry.oracle_sql())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
