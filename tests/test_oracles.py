"""Every query with an oracle gives the rows of its SQL on the smallest tables; the others give rows."""

import math
import os

import duckdb
import pytest

from gridloom import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t[:-8]} as select * from read_parquet('{SF}/{t}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, oracle, name):
    found = QUERIES[name](spark, SF)
    want = oracle.sql(ORACLES[name])
    names = sorted(found.columns)
    assert names == sorted(want.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in found.collect())
    order = [want.columns.index(c) for c in names]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
