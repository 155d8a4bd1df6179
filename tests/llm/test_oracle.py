"""The corpus queries that have a DuckDB statement, against it."""

import pytest
from compare import difference, duck

from ledgerloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_statement(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLE[name]) is None
