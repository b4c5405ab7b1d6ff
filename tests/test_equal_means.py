"""Means of the same scores, summed in another order, are ties."""

import datetime

from quorate.plans import catalog


def test_rank_shifts_ties_equal_means(spark, tmp_path):
    day = {s: datetime.date(s, 3, 1) for s in (1995, 1996)}
    orders = [(1, x, day[1995]) for x in (0.1, 0.2, 0.3)] + [(2, x, day[1995]) for x in (0.3, 0.2, 0.1)] + [(3, 0.9, day[1995])]
    orders += [(p, 1.0 * p, day[1996]) for p in (1, 2, 3)]
    assert 0.1 + 0.2 + 0.3 != 0.3 + 0.2 + 0.1
    spark.createDataFrame(orders, "o_custkey long, o_totalprice double, o_orderdate date").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    out = {r.person: (r.rank_before, r.rank_after) for r in catalog.QUERIES["rank_shifts"](spark, str(tmp_path)).collect()}
    assert out == {1: (1.5, 1.0), 2: (1.5, 2.0), 3: (3.0, 3.0)}
