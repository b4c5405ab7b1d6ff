"""Scores across sessions: bridges, linking, shifts, pooled careers, stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import guarded_corr, ratio
from .ranks import with_ranks


def turnover(scores: DataFrame) -> DataFrame:
    """Per pair of neighbouring sessions: who stayed, left and came."""
    seen = scores.select("person", "session").distinct()
    after = seen.select("person", (F.col("session") - 1).alias("session"), F.lit(1).alias("later"))
    both = seen.withColumn("earlier", F.lit(1)).join(after, ["person", "session"], "full")
    out = both.groupBy("session").agg(F.count(F.when(F.col("earlier").isNotNull() & F.col("later").isNotNull(), 1)).alias("stayed"), F.count(F.when(F.col("later").isNull(), 1)).alias("left"), F.count(F.when(F.col("earlier").isNull(), 1)).alias("came"))
    return out


def bridges(scores: DataFrame) -> DataFrame:
    """(person, session, score, after): scores of persons present in a session and the next."""
    after = scores.select("person", (F.col("session") - 1).alias("session"), F.col("score").alias("after"))
    return scores.join(after, ["person", "session"])


def links(bridged: DataFrame, trim: float = 0.1, least: int = 20) -> DataFrame:
    """Straight lines from a session's scale to the next one's, fitted twice: without the worst residuals the second time.

    Fewer than ``least`` bridges give the identity.
    """
    first = bridged.groupBy("session").agg(F.regr_slope("after", "score").alias("m"), F.regr_intercept("after", "score").alias("c"))
    rows = bridged.join(first, "session").withColumn("off", F.abs(F.col("after") - F.col("m") * F.col("score") - F.col("c")))
    order = Window.partitionBy("session").orderBy("off", "person")
    rows = rows.withColumns({"i": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("session"))}).where(F.col("i") <= F.floor(F.col("n") * (1 - trim)))
    out = rows.groupBy("session").agg(F.max("n").alias("bridges"), F.count("*").alias("used"), F.regr_slope("after", "score").alias("slope"), F.regr_intercept("after", "score").alias("intercept"))
    enough = F.col("bridges") >= least
    return out.select("session", "bridges", "used", F.when(enough, F.col("slope")).otherwise(1.0).alias("slope"), F.when(enough, F.col("intercept")).otherwise(0.0).alias("intercept"))


def shifts(bridged: DataFrame, movers: float = 1.0) -> DataFrame:
    """Change of each bridge's rank (ties averaged) and whether it is beyond ``movers`` deviations."""
    ranked = with_ranks(bridged, {"rank_before": "score", "rank_after": "after"}, ["session"]).withColumn("shift", F.col("rank_after") - F.col("rank_before"))
    std = F.stddev_samp("shift").over(Window.partitionBy("session"))
    return ranked.withColumn("mover", F.coalesce(F.abs("shift") > movers * std, F.lit(False))).select("person", "session", "rank_before", "rank_after", "shift", "mover")


def stability(bridged: DataFrame, least: int = 10) -> DataFrame:
    """Pearson and Spearman correlation over bridges."""
    ranked = with_ranks(bridged, {"ra": "score", "rb": "after"}, ["session"])
    return ranked.groupBy("session").agg(F.count("*").alias("n"), guarded_corr("score", "after", least=least).alias("pearson"), guarded_corr("ra", "rb", least=least).alias("spearman"))


def decomposition(scores: DataFrame) -> DataFrame:
    """Change of the mean between sessions: within those who stayed, and by replacement."""
    b = bridges(scores).groupBy("session").agg(F.avg("score").alias("stay_before"), F.avg("after").alias("stay_after"))
    mean = scores.groupBy("session").agg(F.avg("score").alias("mean"))
    nxt = mean.select((F.col("session") - 1).alias("session"), F.col("mean").alias("mean_after"))
    out = mean.join(nxt, "session").join(b, "session", "left")
    out = out.withColumns({"total": F.col("mean_after") - F.col("mean"), "within": F.col("stay_after") - F.col("stay_before")})
    return out.withColumn("replacement", F.col("total") - F.col("within")).select("session", "total", "within", "replacement")


def careers(scores: DataFrame, variance: float | None = None) -> DataFrame:
    """Random-effects pooling of each person's session scores, sessions weighing by their inverse variance.

    A session's error variance is the variance of its scores over its size; the spread between a
    person's sessions is added by the method of moments.
    """
    errors = scores.groupBy("session").agg((F.var_samp("score") / F.count("*")).alias("v"))
    rows = scores.join(errors, "session").where("v > 0").withColumn("w", 1 / F.col("v"))
    sums = rows.groupBy("person").agg(F.count("*").alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), (F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("fixed"))
    rows = rows.join(sums, "person")
    q = rows.groupBy("person").agg(F.sum(F.col("w") * (F.col("score") - F.col("fixed")) ** 2).alias("q"), F.first("k").alias("k"), F.first("sw").alias("sw"), F.first("sw2").alias("sw2"))
    c = F.col("sw") - F.col("sw2") / F.col("sw")
    q = q.withColumn("tau2", F.when((F.col("k") > 1) & (c > 0), F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / c)).otherwise(0.0))
    rows = rows.select("person", "score", "v").join(q.select("person", "k", "q", "tau2"), "person").withColumn("w", 1 / (F.col("v") + F.col("tau2")))
    out = rows.groupBy("person").agg(F.max("k").alias("sessions"), (F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("career"), (1 / F.sqrt(F.sum("w"))).alias("error"), F.max("tau2").alias("tau2"), F.max("q").alias("q"))
    i2 = F.greatest(F.lit(0.0), F.try_divide(F.col("q") - (F.col("sessions") - 1), F.col("q")))
    return out.withColumn("i2", F.when(F.col("sessions") > 1, F.coalesce(i2, F.lit(0.0))).otherwise(0.0)).drop("q")


def population_shift(scores: DataFrame, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability index between neighbouring sessions, by the earlier one's quantile bins."""
    cuts = scores.groupBy("session").agg(F.percentile("score", [i / bins for i in range(1, bins)]).alias("cuts"))
    place = F.size(F.filter("cuts", lambda c: c < F.col("score")))
    own = scores.join(cuts, "session").select("session", place.alias("bin"), F.lit(1).alias("own"), F.lit(0).alias("other"))
    later = scores.select("person", (F.col("session") - 1).alias("session"), "score").join(cuts, "session").select("session", place.alias("bin"), F.lit(0).alias("own"), F.lit(1).alias("other"))
    n = own.unionAll(later).groupBy("session", "bin").agg(F.sum("own").alias("e"), F.sum("other").alias("a"))
    whole = Window.partitionBy("session")
    n = n.withColumns({"te": F.sum("e").over(whole), "ta": F.sum("a").over(whole)}).where("te > 0 and ta > 0")
    pe, pa = F.greatest(ratio(F.col("e"), F.col("te")), F.lit(floor)), F.greatest(ratio(F.col("a"), F.col("ta")), F.lit(floor))
    return n.groupBy("session").agg(F.sum((pa - pe) * F.log(pa / pe)).alias("psi"))


def intraclass(bridged: DataFrame) -> DataFrame:
    """One-way intraclass correlation of pairs of scores."""
    rows = bridged.withColumn("m", (F.col("score") + F.col("after")) / 2)
    grand = rows.withColumn("g", F.avg("m").over(Window.partitionBy("session")))
    out = grand.groupBy("session").agg(F.count("*").alias("n"), (2 * F.sum((F.col("m") - F.col("g")) ** 2)).alias("ssb"), F.sum((F.col("score") - F.col("m")) ** 2 + (F.col("after") - F.col("m")) ** 2).alias("ssw"))
    msb, msw = F.try_divide(F.col("ssb"), F.col("n") - 1), F.try_divide(F.col("ssw"), F.col("n"))
    return out.select("session", "n", F.try_divide(msb - msw, msb + msw).alias("icc"))
