"""Member profiles, syntheses over several measures, trajectories and model checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_where, ratio
from ..plans.adapter import ABSENT, YEA
from . import agreement, cohesion
from .meetings import meetings


def unified(members: DataFrame, *measures: DataFrame) -> DataFrame:
    """Members with every measure (keyed by voter) at their side; missing ones stay null."""
    return reduce(lambda left, right: left.join(right, "voter", "left"), measures, members)


def scorecard(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Long form: one row per voter and measure with its percentile within the chamber."""
    long = wide.select("voter", "chamber", F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns))).alias("m")).select("voter", "chamber", "m.*").where("value is not null")
    over = Window.partitionBy("chamber", "measure")
    return long.withColumn("percentile", F.row_number().over(over.orderBy(F.round("value", 9), "voter")) / F.count("*").over(over))


def extremes(wide: DataFrame, column: str, k: int = 3) -> DataFrame:
    """The ``k`` highest and lowest members of each chamber by one measure."""
    value = F.round(column, 9)
    top, low = Window.partitionBy("chamber").orderBy(F.desc(value), "voter"), Window.partitionBy("chamber").orderBy(value, "voter")
    known = wide.where(F.col(column).isNotNull())
    out = known.withColumns({"top": F.row_number().over(top), "low": F.row_number().over(low)}).where((F.col("top") <= k) | (F.col("low") <= k))
    return out.select("chamber", "voter", column, F.when(F.col("top") <= k, "top").otherwise("bottom").alias("end"))


def notable_defections(votes: DataFrame, members: DataFrame, per_voter: int = 3) -> DataFrame:
    """Each voter's defections on the closest party votes."""
    rows = cohesion.own_side(votes, members).where("choice <> own")
    order = Window.partitionBy("voter").orderBy(F.desc(F.round("weight", 9)), "item")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_voter).select("voter", "place", "item", "choice", "weight")


def running_defections(votes: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """Defections so far after each party vote day."""
    rows = cohesion.own_side(votes, members).join(items.select("item", "day"), "item")
    by_day = rows.groupBy("voter", "day").agg(count_where(F.col("choice") != F.col("own")).alias("defections"), F.count("*").alias("party_votes"))
    over = Window.partitionBy("voter").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return by_day.select("voter", "day", F.sum("defections").over(over).alias("so_far"), F.sum("party_votes").over(over).alias("of"))


def record(votes: DataFrame, members: DataFrame) -> DataFrame:
    """Each voter's Yea rate on contested and other items."""
    coo = agreement.encode(votes)
    share = coo.groupBy("item").agg((F.least(F.avg("y"), 1 - F.avg("y")) >= 0.3).alias("contested"))
    rows = coo.join(share, "item").join(members.select("voter", "party"), "voter")
    return rows.groupBy("voter", "party").agg(F.avg(F.when(F.col("contested"), F.col("y"))).alias("contested_rate"), F.avg(F.when(~F.col("contested"), F.col("y"))).alias("other_rate"), F.count("*").alias("n"))


def motion_rates(votes: DataFrame, items: DataFrame, members: DataFrame, word: str) -> DataFrame:
    """Yea rates by party on motions that hold a word, beside all others."""
    rows = votes.where(F.col("choice") != ABSENT).join(items.select("item", "motion"), "item").join(members.select("voter", "party"), "voter")
    hit = F.lower("motion").contains(word.lower())
    yea = (F.col("choice") == YEA).cast("int")
    return rows.groupBy("party").agg(F.avg(F.when(hit, yea)).alias("with_word"), F.avg(F.when(~hit, yea)).alias("without"), count_where(hit).alias("n"))


def party_blocks(paired: DataFrame, members: DataFrame) -> DataFrame:
    """Mean agreement and kappa within and between parties."""
    p = members.select("voter", "party")
    rows = paired.join(p.toDF("a", "pa"), "a").join(p.toDF("b", "pb"), "b")
    return rows.groupBy(F.least("pa", "pb").alias("one"), F.greatest("pa", "pb").alias("other")).agg(F.count("*").alias("pairs"), F.avg("agreement").alias("agreement"), F.avg("kappa").alias("kappa"))


def trajectories(scores: DataFrame) -> DataFrame:
    """Number of sessions, net and total movement of each person's score."""
    over = Window.partitionBy("person").orderBy("session")
    steps = scores.withColumn("step", F.col("score") - F.lag("score").over(over))
    return steps.groupBy("person").agg(F.count("*").alias("sessions"), F.sum("step").alias("net"), F.sum(F.abs("step")).alias("total"), F.max(F.abs("step")).alias("largest"))


def gaps(scores: DataFrame) -> DataFrame:
    """Returns after sessions missed: (person, left, back, missed)."""
    over = Window.partitionBy("person").orderBy("session")
    rows = scores.select("person", "session", F.lag("session").over(over).alias("left"))
    return rows.where(F.col("session") - F.col("left") > 1).select("person", "left", F.col("session").alias("back"), (F.col("session") - F.col("left") - 1).alias("missed"))


def lists(text_rows: DataFrame, key: str, column: str, separator: str = "; ") -> DataFrame:
    """One row per entry of a text list, with its place; blank entries are dropped."""
    parts = text_rows.select(key, F.posexplode(F.split(column, separator)).alias("place", "entry"))
    return parts.select(key, "place", F.trim("entry").alias("entry")).where("entry <> ''")


def residual_correlations(scored: DataFrame, least: int = 3, flag: float = 0.2) -> DataFrame:
    """Correlation of prediction residuals between items over common voters (Yen's Q3), flagged when large."""
    rows = scored.select("voter", "item", (F.col("y") - F.col("p")).alias("e"))
    met = meetings(rows, "voter", "item", F.col("e"), least, binary=False)
    mean = lambda c: ratio(F.col(c), F.col("n"))
    va, vb = mean("saa") - mean("sa") * mean("sa"), mean("sbb") - mean("sb") * mean("sb")
    q3 = F.when((va > 1e-12) & (vb > 1e-12), (mean("sab") - mean("sa") * mean("sb")) / F.sqrt(va * vb))
    return met.select("a", "b", "n", q3.alias("q3")).where(F.col("q3").isNotNull()).withColumn("flag", F.abs("q3") > flag)


def log_likelihood(scored: DataFrame) -> DataFrame:
    """Log likelihood, geometric mean probability and reduction of error of each party's votes."""
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("p")))
    like = F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p)
    wrong = ((F.col("p") >= 0.5).cast("int") != F.col("y")).cast("int")
    out = scored.groupBy("party").agg(F.sum(like).alias("log_likelihood"), F.exp(F.avg(like)).alias("gmp"), F.sum(wrong).alias("errors"), F.least(F.sum("y"), F.sum(1 - F.col("y"))).alias("baseline_errors"))
    return out.withColumn("apre", 1 - ratio(F.col("errors"), F.col("baseline_errors")))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Mean prediction and outcome in bins of the predicted probability."""
    place = F.least(F.floor(F.round(F.col("p"), 9) * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("observed"))
