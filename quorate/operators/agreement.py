"""Encoded votes (long form, never a wide matrix), their filters, and pairwise agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import guarded_corr, ratio
from ..plans.adapter import ABSENT, YEA
from .meetings import meetings


def encode(votes: DataFrame) -> DataFrame:
    """(voter, item, y): 1 for Yea, 0 for Nay, other choices left out."""
    return votes.where(F.col("choice") != ABSENT).select("voter", "item", (F.col("choice") == YEA).cast("int").alias("y"))


def contested_only(coo: DataFrame, contested: float = 0.1, least_votes: int = 20) -> DataFrame:
    """Drops lopsided items, then voters with few votes on the items that stay."""
    share = coo.groupBy("item").agg(F.avg("y").alias("p"))
    kept = coo.join(share.where(F.least(F.col("p"), 1 - F.col("p")) >= contested).select("item"), "item", "left_semi")
    return kept.withColumn("n", F.count("*").over(Window.partitionBy("voter"))).where(F.col("n") >= least_votes).drop("n")


def sparsity(coo: DataFrame) -> DataFrame:
    out = coo.agg(F.count("*").alias("cells"), F.countDistinct("voter").alias("voters"), F.countDistinct("item").alias("items"))
    return out.withColumn("sparsity", 1 - ratio(F.col("cells"), F.col("voters") * F.col("items")))


def item_total(coo: DataFrame, least: int = 5, low: float = 0.1) -> DataFrame:
    """Correlation of each item with its voters' overall Yea rate."""
    rate = F.avg("y").over(Window.partitionBy("voter"))
    rows = coo.withColumn("rate", rate)
    out = rows.groupBy("item").agg(F.count("*").alias("n"), F.coalesce(guarded_corr("y", "rate"), F.lit(0.0)).alias("r"))
    return out.where(F.col("n") >= least).withColumn("low", F.abs("r") < low)


def pairs(coo: DataFrame, shared: int = 10) -> DataFrame:
    """(a, b, n, agreement, kappa) for pairs of voters with enough common items; kappa is 1 where chance is sure."""
    met = meetings(coo, "item", "voter", F.col("y"), shared, ("sa", "sb", "sab"))
    same = F.col("n") - F.col("sa") - F.col("sb") + 2 * F.col("sab")
    met = met.withColumns({"agreement": ratio(same, F.col("n")), "pa": ratio(F.col("sa"), F.col("n")), "pb": ratio(F.col("sb"), F.col("n"))})
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    kappa = F.when(chance > 1 - 1e-12, 1.0).otherwise(F.try_divide(F.col("agreement") - chance, 1 - chance))
    return met.withColumn("kappa", kappa).select("a", "b", "n", "agreement", "kappa")


def both_ways(paired: DataFrame) -> DataFrame:
    flipped = paired.select(F.col("b").alias("a"), F.col("a").alias("b"), *[c for c in paired.columns if c not in ("a", "b")])
    return paired.unionByName(flipped)


def neighbours(paired: DataFrame, k: int = 5) -> DataFrame:
    """Each voter's ``k`` closest by agreement."""
    order = Window.partitionBy("a").orderBy(F.desc("agreement"), F.desc("n"), "b")
    return both_ways(paired).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("a", "place", "b", "n", "agreement")


def imputed_rates(coo: DataFrame) -> DataFrame:
    """The value that fills a voter's missing cells: the own Yea rate."""
    return coo.groupBy("voter").agg(F.avg("y").alias("fill"), F.count("*").alias("known"))
