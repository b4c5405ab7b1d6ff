"""Measures by topic of the items, and positions drawn from item vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import guarded_corr
from ..plans.adapter import YEA


def eligible(topics: DataFrame, votes: DataFrame, least: int = 10) -> DataFrame:
    """Topics with at least ``least`` items that were voted on."""
    voted = votes.select("item").distinct().withColumn("voted", F.lit(1))
    out = topics.join(voted, "item", "left").groupBy("topic").agg(F.countDistinct("item").alias("items"), F.countDistinct(F.when(F.col("voted") == 1, F.col("item"))).alias("with_votes"))
    return out.where(F.col("with_votes") >= least)


def cohesion_by_topic(riced: DataFrame, topics: DataFrame) -> DataFrame:
    rows = riced.where("rice is not null").join(topics, "item")
    return rows.groupBy("topic", "party").agg(F.avg("rice").alias("rice"), F.count("*").alias("items")).withColumn("split", 1 - F.col("rice"))


def passage(votes: DataFrame, topics: DataFrame) -> DataFrame:
    """Share of each topic's items with more Yea than Nay votes."""
    tally = votes.groupBy("item").agg(F.count(F.when(F.col("choice") == YEA, 1)).alias("yea"), F.count(F.when(F.col("choice") == "Nay", 1)).alias("nay")).where("yea + nay > 0")
    return tally.join(topics, "item").groupBy("topic").agg(F.count("*").alias("items"), F.avg((F.col("yea") > F.col("nay")).cast("int")).alias("passed"))


def rates(coo: DataFrame, topics: DataFrame, least: int = 5) -> DataFrame:
    """(voter, topic, rate, n): Yea rates of voters with at least ``least`` votes in the topic."""
    return coo.join(topics, "item").groupBy("voter", "topic").agg(F.avg("y").alias("rate"), F.count("*").alias("n")).where(F.col("n") >= least)


def topic_correlations(rated: DataFrame, least: int = 3) -> DataFrame:
    a, b = rated.select("voter", F.col("topic").alias("one"), F.col("rate").alias("ra")), rated.select("voter", F.col("topic").alias("two"), F.col("rate").alias("rb"))
    return a.join(b, "voter").where("one < two").groupBy("one", "two").agg(F.count("*").alias("n"), guarded_corr("ra", "rb", least=least).alias("r"))


def topic_outliers(rated: DataFrame, coo: DataFrame, top: int = 10) -> DataFrame:
    """Voters whose standing in a topic departs most from their overall standing (population z-scores)."""
    overall = coo.groupBy("voter").agg(F.avg("y").alias("overall"))
    rows = rated.join(overall, "voter")
    over = Window.partitionBy("topic")
    z = lambda c: F.try_divide(F.col(c) - F.avg(c).over(over), F.stddev_pop(c).over(over))
    gap = rows.withColumn("gap", z("rate") - z("overall")).where("gap is not null")
    order = over.orderBy(F.desc(F.round(F.abs("gap"), 9)), "voter")
    return gap.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("topic", "place", "voter", "gap")


def vote_vectors(votes: DataFrame, vectors: DataFrame, least: int = 20) -> DataFrame:
    """(voter, place, value): mean of the items' vectors, turned round for Nay votes."""
    sign = F.when(F.col("choice") == YEA, 1.0).when(F.col("choice") == "Nay", -1.0)
    rows = votes.withColumn("sign", sign).where("sign is not null").join(vectors, "item")
    kept = rows.withColumn("n", F.count("*").over(Window.partitionBy("voter"))).where(F.col("n") >= least)
    spread = kept.select("voter", "sign", F.posexplode("vector").alias("place", "v"))
    return spread.groupBy("voter", "place").agg(F.avg(F.col("sign") * F.col("v").cast("double")).alias("value"))


def windowed_positions(coo: DataFrame, members: DataFrame, items: DataFrame, width: int = 75, step: int = 15, least: int = 20) -> DataFrame:
    """(chamber, window, voter, score): first principal component in windows of items, Republicans up."""
    rows = coo.join(members.select("voter", "party", "chamber"), "voter")
    order = Window.partitionBy("chamber").orderBy("day", "item")
    placed = rows.select("chamber", "item").distinct().join(items.select("item", "day"), "item").withColumn("i", F.row_number().over(order) - 1)
    last, first = F.floor(F.col("i") / step), F.greatest(F.lit(0), F.ceil((F.col("i") - width + 1) / step))
    spread = placed.where(last >= first).select("chamber", "item", F.explode(F.sequence(first, last)).alias("window"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        counts = part.groupby("voter")["y"].transform("size")
        part = part[counts >= min(least, part["item"].nunique() // 2)]
        if part["voter"].nunique() < 5:
            return pd.DataFrame({"chamber": pd.Series(dtype=object), "window": pd.Series(dtype="int64"), "voter": pd.Series(dtype=object), "score": pd.Series(dtype=float)})
        m = part.pivot_table(index="voter", columns="item", values="y")
        x = m.to_numpy(float)
        x = np.where(np.isnan(x), np.nanmean(x, axis=1, keepdims=True), x)
        u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        score = u[:, 0] * s[0]
        republican = part.drop_duplicates("voter").set_index("voter")["party"].reindex(m.index).eq("Republican").to_numpy()
        if republican.any() and (~republican).any() and score[republican].mean() < score[~republican].mean():
            score = -score
        return pd.DataFrame({"chamber": part["chamber"].iloc[0], "window": part["window"].iloc[0], "voter": [str(v) for v in m.index], "score": score})

    joined = rows.join(spread, ["chamber", "item"])
    return joined.groupBy("chamber", "window").applyInPandas(fit, "chamber string, window long, voter string, score double")
