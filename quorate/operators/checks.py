"""Comparisons of scores, constants that link scales, and fit of predicted votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .ranks import with_ranks
from ..plans.adapter import NAY, YEA


def rollcall_codes(votes: DataFrame) -> DataFrame:
    """(voter, item, code) in the roll-call coding of scaling programs: 1 Yea, 6 Nay, 9 neither."""
    return votes.select("voter", "item", F.when(F.col("choice") == YEA, 1).when(F.col("choice") == NAY, 6).otherwise(9).alias("code"))


def polarity_members(points: DataFrame, votes: DataFrame, least: float = 0.5) -> DataFrame:
    """Each chamber's member of the greatest position among those who cast at least ``least`` of their votes."""
    cast = votes.groupBy("voter").agg(F.avg(F.col("choice").isin(YEA, NAY).cast("int")).alias("cast")).where(F.round("cast", 9) >= least)
    order = Window.partitionBy("chamber").orderBy(F.desc("xi"), "voter")
    return points.join(cast, "voter").withColumn("i", F.row_number().over(order)).where("i = 1").select("chamber", "voter", "xi")


def sign_aligned(df: DataFrame, score: str, by: str) -> DataFrame:
    """``df`` with ``score`` negated where it runs against ``by``."""
    r = df.agg(F.corr(score, by).alias("r"))  # one row
    return df.crossJoin(F.broadcast(r)).withColumn(score, F.when(F.col("r") < 0, -F.col(score)).otherwise(F.col(score))).drop("r")


def comparison(df: DataFrame, key: str, *scores: str) -> DataFrame:
    """Ranks from the top (ties averaged, whole part) of several scores and the widest gap between any two."""
    ranks = [f"rank_{s}" for s in scores]
    negated = df.select(key, *scores).withColumns({f"_{s}": -F.col(s) for s in scores})
    ranked = with_ranks(negated, {r: f"_{s}" for r, s in zip(ranks, scores, strict=True)}).withColumns({r: F.floor(r).cast("int") for r in ranks})
    return ranked.select(key, *scores, *ranks, (F.greatest(*ranks) - F.least(*ranks)).alias("apart"))


def linking_constants(anchors: DataFrame) -> DataFrame:
    """(method, slope, intercept) that put target parameters (a2, b2) on the scale of (a1, b1): mean/mean and mean/sigma.

    Null where a mean or a deviation to divide by is zero.
    """
    sums = anchors.agg(F.avg("a1").alias("ma1"), F.avg("a2").alias("ma2"), F.avg("b1").alias("mb1"), F.avg("b2").alias("mb2"), F.stddev_samp("b1").alias("s1"), F.stddev_samp("b2").alias("s2"))
    slopes = F.explode(F.array(F.struct(F.lit("mean/mean").alias("method"), F.try_divide("ma1", "ma2").alias("slope")), F.struct(F.lit("mean/sigma").alias("method"), F.try_divide("s1", "s2").alias("slope"))))
    return sums.select(slopes.alias("x"), "mb1", "mb2").select("x.method", "x.slope", (F.col("mb1") - F.col("x.slope") * F.col("mb2")).alias("intercept"))


def top_concordance(df: DataFrame, key: str, one: str, two: str, k: int = 20) -> DataFrame:
    """Kendall's tau-b of two scores over the ``k`` rows greatest by the first."""
    top = df.select(key, one, two).dropna().orderBy(F.desc(one), key).limit(k)
    x, z = top.toDF("k1", "x1", "y1"), top.toDF("k2", "x2", "y2")
    pairs = x.join(F.broadcast(z), F.col("k1") < F.col("k2"))  # at most k rows a side
    sx, sy = F.signum(F.col("x1") - F.col("x2")), F.signum(F.col("y1") - F.col("y2"))
    out = pairs.agg(F.count("*").alias("pairs"), F.sum(sx * sy).alias("s"), F.sum(F.abs(sx)).alias("tx"), F.sum(F.abs(sy)).alias("ty"))
    return out.select("pairs", F.try_divide("s", F.sqrt(F.col("tx") * F.col("ty"))).alias("tau"))


def fit_by(scored: DataFrame, *group: str, beyond: float = 1.959963984540054) -> DataFrame:
    """Observed Yeas against those the probabilities expect; a group misfits outside its 95 % range."""
    spread = F.sqrt(F.sum(F.col("p") * (1 - F.col("p"))))
    out = scored.groupBy(*group).agg(F.count("*").alias("n"), F.sum("y").alias("yea"), F.sum("p").alias("expected"), spread.alias("sd"))
    z = ratio(F.col("yea") - F.col("expected"), F.col("sd"))
    return out.withColumn("z", z).withColumn("misfit", F.coalesce(F.abs(F.round("z", 9)) > beyond, F.lit(False)))


def surprises_by_class(scored: DataFrame, top: int = 20) -> DataFrame:
    """The most confident wrong predictions of each kind: a Yea that came out Nay, and the other way."""
    wrong = scored.where((F.round("p", 9) >= 0.5).cast("int") != F.col("y")).withColumns({"kind": F.when(F.col("y") == 0, "false Yea").otherwise("false Nay"), "error": F.round(F.abs(F.col("p") - F.col("y")), 9)})
    order = Window.partitionBy("kind").orderBy(F.desc("error"), "voter", "item")
    return wrong.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("kind", "place", "voter", "item", "error")
