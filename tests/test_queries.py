"""Registered queries against their DuckDB statements, on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from compare import difference, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

LEDGER = [name for name in driver.queries()
          if not driver.corpus or name not in {*driver.corpus.QUERIES, "pipeline"}]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_statement():
    assert set(LEDGER) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", LEDGER)
def test_query(spark, con, name):
    assert difference(driver.queries()[name](spark, SF), con, driver.oracle_sql()[name]) is None
