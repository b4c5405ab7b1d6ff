"""Series over time: tumbling windows, moving averages, count windows, changes, halves."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed_rice(riced: DataFrame, items: DataFrame, width: str = "7 days") -> DataFrame:
    """Mean Rice of each party in tumbling windows from the epoch on."""
    rows = riced.where("rice is not null").join(items.select("item", "day"), "item").withColumn("ts", F.col("day").cast("timestamp_ntz"))
    return rows.groupBy(F.window("ts", width).alias("w"), "party").agg(F.avg("rice").alias("mean"), F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("start"), "party", "mean", "n")


def moving_average(riced: DataFrame, items: DataFrame, rows: int = 15) -> DataFrame:
    """Mean of the last ``rows`` items of each party, where there are that many."""
    over = Window.partitionBy("party").orderBy("day", "item").rowsBetween(-(rows - 1), 0)
    joined = riced.where("rice is not null").join(items.select("item", "day"), "item")
    return joined.select("party", "day", "item", F.avg("rice").over(over).alias("mean"), F.count("*").over(over).alias("n")).where(F.col("n") == rows).drop("n")


def monthly(votes: DataFrame, items: DataFrame) -> DataFrame:
    rows = votes.join(items.select("item", "day"), "item")
    return rows.groupBy(F.date_format("day", "yyyy-MM").alias("month")).pivot("choice", ["Yea", "Nay", "Absent and Not Voting"]).count().select("month", *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(n) for c, n in (("Yea", "yea"), ("Nay", "nay"), ("Absent and Not Voting", "absent"))))


def count_windows(riced: DataFrame, items: DataFrame, width: int = 75, step: int = 15) -> DataFrame:
    """Mean Rice in overlapping windows of ``width`` items, one starting every ``step`` items."""
    joined = riced.where("rice is not null").join(items.select("item", "day"), "item")
    order = Window.partitionBy("party").orderBy("day", "item")
    placed = joined.withColumns({"i": F.row_number().over(order) - 1, "total": F.count("*").over(Window.partitionBy("party"))})
    last, first = F.floor(F.col("i") / step), F.greatest(F.lit(0), F.ceil((F.col("i") - width + 1) / step))
    spread = placed.where(last >= first).withColumn("window", F.explode(F.sequence(first, last))).where(F.col("window") * step + width <= F.col("total"))
    return spread.groupBy("party", "window").agg(F.avg("rice").alias("mean"), F.count("*").alias("n"))


def halves(riced: DataFrame, items: DataFrame) -> DataFrame:
    """Mean Rice of each party's first and second half of items, and the change."""
    joined = riced.where("rice is not null").join(items.select("item", "day"), "item")
    placed = joined.withColumns({"i": F.row_number().over(Window.partitionBy("party").orderBy("day", "item")), "total": F.count("*").over(Window.partitionBy("party"))})
    early = F.col("i") * 2 <= F.col("total")
    out = placed.groupBy("party").agg(F.avg(F.when(early, F.col("rice"))).alias("early"), F.avg(F.when(~early, F.col("rice"))).alias("late"))
    return out.withColumn("change", F.col("late") - F.col("early"))


def day_of_session(items: DataFrame) -> DataFrame:
    """Days since the chamber's first item, from 0."""
    return items.select("item", "chamber", F.datediff("day", F.min("day").over(Window.partitionBy("chamber"))).alias("day_of_session"))


def close_pairs(marks: DataFrame, days: int = 14) -> DataFrame:
    """Pairs (a, b) of marks (key, day) at most ``days`` apart, by bucketed equality rather than a range join."""
    left = marks.select(F.col("key").alias("a"), F.col("day").alias("day_a"), F.floor(F.datediff("day", F.lit("1970-01-01")) / days).alias("bucket"))
    right = marks.select(F.col("key").alias("b"), F.col("day").alias("day_b"), F.floor(F.datediff("day", F.lit("1970-01-01")) / days).alias("home"))
    right = right.withColumn("bucket", F.explode(F.array(F.col("home") - 1, F.col("home"), F.col("home") + 1)))
    return left.join(right, "bucket").where((F.col("a") < F.col("b")) & (F.abs(F.datediff("day_a", "day_b")) <= days)).select("a", "b", F.datediff("day_b", "day_a").alias("gap"))


def pelt(values: np.ndarray, penalty: float, least: int = 5) -> list[int]:
    """Ends of the segments that minimise squared error plus a penalty for each, with pruning."""
    n = len(values)
    one, two = np.r_[0, np.cumsum(values)], np.r_[0, np.cumsum(values**2)]
    cost = lambda s, t: two[t] - two[s] - (one[t] - one[s]) ** 2 / (t - s)
    best, before, open_ = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), [0]
    best[0] = -penalty
    for t in range(least, n + 1):
        options = [(best[s] + cost(s, t) + penalty, s) for s in open_ if t - s >= least]
        if options:
            best[t], before[t] = min(options)
            open_ = [s for s in open_ if t - s < least or best[s] + cost(s, t) <= best[t]]
        if t - least + 1 >= least:
            open_.append(t - least + 1)
    ends, t = [], n
    while t > 0 and np.isfinite(best[t]):
        ends.append(t)
        t = before[t]
    return ends[::-1]


def change_points(series: DataFrame, penalty: float | None = None) -> DataFrame:
    """(party, place): first places of new segments of each party's series (party, place, value)."""

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        x = rows["value"].to_numpy(dtype=float)
        if len(x) < 10:
            return pd.DataFrame({"party": pd.Series(dtype=object), "place": pd.Series(dtype="int64")})
        ends = pelt(x, penalty if penalty is not None else 2 * np.log(len(x)) * max(float(np.var(np.diff(x))) / 2, 1e-9))
        places = rows["place"].to_numpy()[[e for e in ends[:-1]]]
        return pd.DataFrame({"party": rows["party"].iloc[0], "place": places})

    return series.groupBy("party").applyInPandas(find, "party string, place long")


