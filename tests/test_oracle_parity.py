"""Every registered query against its DuckDB oracle at sf0.001 (row count, column names, values)."""

import decimal

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from tessera.plans.registry import ORACLE, QUERIES, TABLES

SF = "/root/testdata/sf0.001"
CALLS = E.queries()


def _norm(v):
    if v is None or (isinstance(v, float) and pd.isna(v)):
        return "NULL"
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 9))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = CALLS[key](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if key not in ORACLE:
        assert df.columns  # rows-only: it runs and has a stable schema
        return
    cur = duck.execute(ORACLE[key])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert _rows(got, df.columns) == _rows(want, cols)
