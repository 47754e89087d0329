"""Every registered query of the dialect against its DuckDB text, on the smallest tables."""

import datetime
import decimal
import math
import os

import pytest

from quernel import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, bytearray):
        return bytes(v)
    return v.isoformat() if isinstance(v, datetime.date) else v


def ordered(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows) if not any(None in r for r in rows) else sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    con = duck.execute(catalogue.ORACLE_SQL[name])
    names, want = [d[0] for d in con.description], con.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert ordered(df.columns, got) == ordered(names, want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["flagship"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "c_acctbal" not in plan
    plan = catalogue.QUERIES["in_list"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "In(c_nationkey, [1,3,5])" in plan
