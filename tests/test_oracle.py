"""Every registered query against its DuckDB oracle on the sf0.001 tables
(the driver runs the same comparison at sf0.01)."""

import pytest
from oracle_harness import compare, duck

from __spark_entry__ import entry, oracle_sql, queries
from contentlens.plans.catalog import QUERIES
from contentlens.plans.oracle import SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    r = compare(spark, name, SF, con)
    assert r["ok"], r


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0
