"""The queries that SQL can express against DuckDB."""

import pytest

import oracle
from docweft.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_equals_sql(spark, sf, name):
    oracle.compare(spark, oracle.connect(sf), Q.QUERIES[name], Q.ORACLES[name], sf)
