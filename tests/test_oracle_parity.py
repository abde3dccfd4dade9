"""Every binding with an oracle must equal DuckDB on the same Parquet
(rows, column names, order-insensitive values)."""

import pytest

import __spark_entry__ as E
from oracle import compare, duck
from conftest import SF_SMALL

ORACLE = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", ORACLE)
def test_matches_duckdb(spark, con, name):
    r = compare(spark, name, SF_SMALL, con)
    assert r["ok"], r


def test_every_query_registered_with_callable():
    q = E.queries()
    assert len(q) >= 100
    assert set(E.oracle_sql()) <= set(q)
