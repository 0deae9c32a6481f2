"""Every query that has SQL must give the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, _rows

SF = "/root/testdata/sf0.001"
# Full-size fits take minutes; tools/compare.py runs them, the operators have tests of their own.
FITS = {"train_boosted_trees", "search_best_params"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql().keys() - FITS))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = _rows(df.columns, df.collect())
    res = con.execute(entry.oracle_sql()[name])
    assert got == _rows([c[0] for c in res.description], res.fetchall())


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).count() == 13


def test_no_oracle_without_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
