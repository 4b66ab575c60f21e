"""Registered queries of the operators against their SQL."""

import pytest
from oracle import same

from quillon.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    same(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])
