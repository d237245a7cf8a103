"""The registered queries against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(name for plans in entry.PLANS for name in plans.QUERIES)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        files = path if os.path.isfile(path) else path + "/*.parquet"
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name in entry.oracle_sql():
        want = con.sql(entry.oracle_sql()[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_flagship(spark, con):
    assert entry.entry(spark).columns == ["_key", "score"]
