"""Every registered query of the engine against its SQL."""

import pytest
from oracle import same

from quillon import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    same(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_stable_sort(spark):
    import duckdb

    got = [r[0] for r in queries.QUERIES["sort_stable"](spark, SF).collect()]
    rows = duckdb.sql(f"SELECT c_custkey, c_mktsegment FROM '{SF}/customer.parquet'").fetchall()
    assert got == [k for k, _ in sorted(rows, key=lambda r: r[1])][:40]


def test_plans_reach_the_scan(spark):
    plan = queries.session(spark, SF).sql(queries.FLAGSHIP)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(l_returnflag,R)" in plan and "GreaterThan(l_quantity,10.0)" in plan
    assert "l_shipdate" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_filters_under_or_and_not_reach_the_scan(spark):
    s = queries.session(spark, SF)
    pushed = lambda text: s.sql(text)._jdf.queryExecution().toString().split("PushedFilters: ")[1].split("]")[0]
    assert "LessThanOrEqual(p_size,10)" in pushed("SELECT p_partkey FROM part WHERE NOT (p_size > 10 AND p_size <> 7)")
    assert "Or(GreaterThan(l_quantity,40.0),GreaterThanOrEqual(l_discount,0.05))" in pushed("SELECT l_orderkey FROM lineitem WHERE l_quantity > 40.0 OR l_discount >= 0.05")
