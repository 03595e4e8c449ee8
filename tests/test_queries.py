"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import pytest

from cairn.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"

def plain(x):
    if x is None or x != x:
        return "-"
    return f"{x:.8g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, tables, name):
    con = tables
    want, got = con.sql(ORACLE_SQL[name]), QUERIES[name](spark, FOLDER)
    assert sorted(want.columns) == sorted(got.columns)
    names = want.columns
    assert sorted(tuple(map(plain, r)) for r in want.fetchall()) == sorted(tuple(plain(r[c]) for c in names) for r in got.collect())


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
