import pytest

import __spark_entry__ as entry
from tests import oracle
from tidemark.plans import catalogue


@pytest.fixture(scope="module")
def duck():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    oracle.same(spark, duck, catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fake_rows_repeat(spark):
    one, two = (catalogue.QUERIES["s_fake"](spark, "").collect() for _ in range(2))
    assert sorted(one) == sorted(two) and len(one) == 1000
    assert {r["code"] for r in one} == {"EUR", "USD", "CHF"} and all(1 <= r["price"] <= 150 and 0 <= r["n"] < 1000 and len(r["tags"]) == 3 for r in one)
    assert 0.05 < sum(r["kind"] is None for r in one) / 1000 < 0.15


def test_sql_and_frames_plan_alike(spark):
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{oracle.DATA}/orders.parquet")
    df.createOrReplaceTempView("plan_orders")
    a = df.where("o_totalprice > 1000").groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("total"))
    b = spark.sql("SELECT o_orderstatus, sum(o_totalprice) AS total FROM plan_orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
    assert a.sameSemantics(b)


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["p_filter"](spark, oracle.DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,45.0)]" in plan
    assert "l_comment" not in plan and "l_extendedprice" not in plan
