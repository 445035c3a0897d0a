"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from termloom.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "part events documents pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    flat = lambda df: sorted(map(str, df[cols].itertuples(index=False, name=None)))
    assert flat(got) == flat(want)
