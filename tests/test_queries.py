import pytest
from oracle import compare

from docloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "name", "normalized_name", "mrp"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_predicates_reach_the_scan(spark):
    from docloom.operators.tenancy import TenantScope

    df = spark.read.parquet(f"{SF}/orders.parquet")
    plan = TenantScope(7, "o_custkey").page(df, newest="o_orderdate", key="o_orderkey").select("o_orderkey")._jdf.queryExecution().toString()
    assert "EqualTo(o_custkey,7)" in plan and "TakeOrderedAndProject" in plan
