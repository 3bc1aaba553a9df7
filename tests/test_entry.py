"""The driver contract: entry() runs, and every registered query with an
oracle matches DuckDB on the smallest data (the driver checks sf0.01)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import rows  # noqa: E402

from jobscope.sources.adapters import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "current_status" in df.columns


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 90


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    pdf = E.queries()[name](spark, SF).toPandas()
    odf = con.execute(E.oracle_sql()[name]).df()
    sc, sr = rows(pdf)
    oc, orr = rows(odf)
    assert sc == oc
    assert sr == orr
