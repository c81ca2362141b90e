"""Every registered query equals its DuckDB oracle (driver contract),
here on sf0.001; the driver checks sf0.01."""

import pytest

import __spark_entry__ as E
from tagweave.plans.catalog import QUERIES
from tagweave.plans.compare import compare, duck

from .conftest import SF_SMALL

KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["name", "text"]
    assert df.count() > 0


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, key, E.queries()[key], E.oracle_sql()[key], SF_SMALL, con)
    assert r["status"] == "SAME", r
