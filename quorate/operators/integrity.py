"""Checks on the raw tables; each returns the offending rows or a small report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_where
from ..plans.adapter import ABSENT, NAY, YEA
from .meetings import meetings


def summary(votes: DataFrame, items: DataFrame, members: DataFrame) -> DataFrame:
    """One row per chamber: items, bills, members and the span of days."""
    by_item = items.groupBy("chamber").agg(F.count("*").alias("items"), F.countDistinct("bill").alias("bills"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return by_item.join(members.groupBy("chamber").agg(F.count("*").alias("members")), "chamber", "left")


def choice_counts(votes: DataFrame) -> DataFrame:
    return votes.groupBy("choice").agg(F.count("*").alias("n"), F.countDistinct("voter").alias("voters"), F.countDistinct("item").alias("items"))


def seats(members: DataFrame) -> DataFrame:
    return members.groupBy("chamber", "party").agg(F.count("*").alias("seats"), F.countDistinct("district").alias("districts"))


def overlapping_service(votes: DataFrame, items: DataFrame, members: DataFrame) -> DataFrame:
    """Members of one chamber and district whose days of voting overlap with the next one's."""
    spans = votes.join(items.select("item", "day"), "item").groupBy("voter").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    seated = members.join(spans, "voter")
    order = Window.partitionBy("chamber", "district").orderBy("first_day", "voter")
    after = seated.withColumns({"next_voter": F.lead("voter").over(order), "next_first": F.lead("first_day").over(order)})
    return after.where("last_day >= next_first").select("chamber", "district", "voter", "next_voter", "last_day", "next_first")


def orphans(votes: DataFrame, items: DataFrame, members: DataFrame) -> DataFrame:
    """Keys without a partner, in both directions."""
    kinds = [
        ("vote without member", votes.select(F.col("voter").alias("key")), members.select(F.col("voter").alias("key"))),
        ("member without vote", members.select(F.col("voter").alias("key")), votes.select(F.col("voter").alias("key"))),
        ("vote without item", votes.select(F.col("item").cast("string").alias("key")), items.select(F.col("item").cast("string").alias("key"))),
        ("item without vote", items.select(F.col("item").cast("string").alias("key")), votes.select(F.col("item").cast("string").alias("key"))),
    ]
    parts = [left.join(right, "key", "left_anti").distinct().select(F.lit(kind).alias("kind"), "key") for kind, left, right in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def repeated(raw: DataFrame, *keys: str) -> DataFrame:
    return raw.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def tally_gaps(raw: DataFrame, votes: DataFrame) -> DataFrame:
    """Items whose raw rows outnumber their distinct votes."""
    a = raw.groupBy("item").agg(F.count("*").alias("rows"))
    b = votes.groupBy("item").agg(F.count("*").alias("votes"), count_where(F.col("choice") == YEA).alias("yea"), count_where(F.col("choice") == NAY).alias("nay"))
    return a.join(b, "item", "full").where(~F.col("rows").eqNullSafe(F.col("votes"))).withColumn("gap", F.col("rows") - F.col("votes"))


def outside_domain(votes: DataFrame, members: DataFrame) -> DataFrame:
    """Counts of rows that break a domain: choices, and chamber against the prefix of the key."""
    bad = votes.agg(count_where(~F.col("choice").isin(YEA, NAY, ABSENT)).alias("n")).select(F.lit("choice").alias("rule"), "n")
    prefix = F.when(F.col("voter").startswith("sen_"), "Senate").otherwise("House")
    return bad.unionAll(members.agg(count_where(prefix != F.col("chamber")).alias("n")).select(F.lit("prefix").alias("rule"), "n"))


def near_duplicate_items(votes: DataFrame, contested: float = 0.1, shared: int = 10, differ: int = 1) -> DataFrame:
    """Pairs of contested items with at least ``shared`` common voters who differ at most ``differ`` times."""
    y = votes.where(F.col("choice") != ABSENT).select("item", "voter", (F.col("choice") == YEA).cast("int").alias("y"))
    share = y.groupBy("item").agg(F.avg("y").alias("p")).where(F.least(F.col("p"), 1 - F.col("p")) >= contested).select("item")
    y = y.join(share, "item", "left_semi")
    pairs = meetings(y, "voter", "item", F.col("y"), shared, ("sa", "sb", "sab"))
    return pairs.select("a", "b", F.col("n").alias("common"), (F.col("sa") + F.col("sb") - 2 * F.col("sab")).alias("differ")).where(F.col("differ") <= differ)
