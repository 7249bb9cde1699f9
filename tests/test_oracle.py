"""Every registered query against its DuckDB statement on the smallest
tables (the driver runs the same comparison at sf0.01), plus the smoke
entry."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from strata.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["host", "n_links", "n_pages"]
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    srows, scols = df.collect(), df.columns
    sql = E.oracle_sql().get(name)
    if sql is None:
        return  # rows-only operator, covered by its own tests
    res = duck.execute(sql)
    dcols = [d[0] for d in res.description]
    assert sorted(scols) == sorted(dcols)
    assert _rows(scols, srows) == _rows(dcols, res.fetchall())


def test_contract_every_query_has_an_oracle():
    q, sql = E.queries(), E.oracle_sql()
    own = {n for n in q if n != "pipeline" and not n.startswith("op")}  # the others may have no SQL form
    assert own <= set(sql) <= set(q)
    assert all(callable(f) for f in q.values()) and all(isinstance(s, str) and s.strip() for s in sql.values())
