"""The registered queries of the ten operations against their SQL, on the smallest tables."""

import glob
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from docloom.llm.queries import ORACLE_SQL, QUERIES


def cell(v):
    return str(v) if v is None or isinstance(v, (str, bool)) else repr(float(v))


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_sql(spark, small_tables, name):
    con = duckdb.connect()
    for p in glob.glob(f"{small_tables}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    got = QUERIES[name](spark, small_tables)
    names = sorted(got.columns)
    truth = con.sql(ORACLE_SQL[name])
    assert sorted(truth.columns) == names
    rows = sorted(tuple(map(cell, r)) for r in got.select(*names).collect())
    assert sorted(tuple(map(cell, r)) for r in truth.select(*names).fetchall()) == rows and rows


def test_all_are_registered():
    known = __spark_entry__.queries()
    assert set(QUERIES) <= set(known) and "pipeline" in known
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(f"op{n}" for n in range(1, 14))
