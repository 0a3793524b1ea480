"""Every query that has SQL gives the rows of that SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from kelpline.plans import queries, sync_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries.QUERIES | sync_queries.QUERIES, queries.ORACLES | sync_queries.ORACLES


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    out = con.sql(ORACLES[name])
    assert sorted(out.columns) == cols
    at = [out.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in out.fetchall())


def test_both_recursive_forms_agree(spark):
    if os.path.isdir(SF):
        a, b = QUERIES["chunk_recursive"](spark, SF), QUERIES["chunk_recursive_native"](spark, SF)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not a.isEmpty()
