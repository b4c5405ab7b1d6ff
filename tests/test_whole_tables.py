"""Queries of pairs and merges take every id of their tables; their rows are held against SQL in test_catalog.py."""

import pytest

from quorate.plans import catalog

SELDOM = {"close_dates": "a % 20 <> 0", "item_projection": "a % 10 <> 0", "residual_correlations": "a % 40 <> 0"}


@pytest.mark.parametrize("name", sorted(SELDOM))
def test_pairs_of_all_ids(spark, tiny, name):
    assert not catalog.QUERIES[name](spark, tiny).where(SELDOM[name]).isEmpty()


def test_staged_match_takes_all_customers(spark, small):
    plan = catalog.QUERIES["staged_match"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "1000" not in plan


def test_keyed_merge_takes_all_orders(spark, tiny):
    orders = spark.read.parquet(f"{tiny}/orders.parquet")
    out = catalog.QUERIES["keyed_merge"](spark, tiny)
    new = orders.where("o_orderstatus = 'P'")
    kept = orders.where("o_orderstatus <> 'P'").join(new.select("o_custkey").distinct(), "o_custkey", "left_anti")
    assert new.count() > 0 and out.count() == new.count() + kept.count()
    assert not out.where("o_orderkey % 2 <> 0 and o_orderkey % 7 <> 0").isEmpty()
