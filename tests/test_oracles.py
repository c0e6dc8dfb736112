"""Every registered query against its DuckDB oracle on the smallest test tables."""

import os

import pytest

from shopcast.queries import oracle_sql, queries
from shopcast.testing import compare, duck

SF = os.environ.get("SHOPCAST_TEST_SF", "/root/testdata/sf0.001")
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    if not os.path.exists(f"{SF}/orders.parquet"):
        pytest.skip("test tables not available")
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    out = compare(name, df, con, ORACLES[name])
    assert out.ok, out.detail


def test_every_query_has_entry():
    import __spark_entry__ as e
    assert set(e.queries()) >= set(queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(ORACLES) == set(queries())  # every query here has an oracle
