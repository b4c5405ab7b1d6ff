"""Statistics that several analyses share, as aggregations."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import guarded_corr, ratio
from .ranks import running, with_ranks


def outliers(df: DataFrame, value: str, group: str, beyond: float = 2.0) -> DataFrame:
    """Rows whose value is over ``beyond`` population deviations from the group's mean."""
    over = Window.partitionBy(group)
    z = F.try_divide(F.col(value) - F.avg(value).over(over), F.stddev_pop(value).over(over))
    return df.withColumn("z", z).where(F.abs("z") > beyond)


def cohens_d(df: DataFrame, value: str, group: str, one: str, two: str) -> DataFrame:
    def side(g: str, fn):
        return fn(F.when(F.col(group) == g, F.col(value)))

    out = df.agg(side(one, F.count).alias("n1"), side(two, F.count).alias("n2"), side(one, F.avg).alias("m1"), side(two, F.avg).alias("m2"), side(one, F.var_samp).alias("v1"), side(two, F.var_samp).alias("v2"))
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), F.col("n1") + F.col("n2") - 2))
    return out.select("n1", "n2", F.try_divide(F.col("m1") - F.col("m2"), pooled).alias("d"))


def correlation(df: DataFrame, x: str, y: str, least: int = 10) -> DataFrame:
    """Pearson with its Fisher interval, and Spearman with ties averaged."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = with_ranks(rows.select(x, y), {"__rx": x, "__ry": y})
    out = ranked.agg(F.count("*").alias("n"), guarded_corr(x, y, least=least).alias("pearson"), guarded_corr("__rx", "__ry", least=least).alias("spearman"))
    z, half = F.atanh("pearson"), 1.959963984540054 / F.sqrt(F.col("n") - 3)
    inside = (F.abs("pearson") < 1) & (F.col("n") > 3)
    return out.withColumns({"low": F.when(inside, F.tanh(z - half)), "high": F.when(inside, F.tanh(z + half))})


def contingency(df: DataFrame, one: str, two: str) -> DataFrame:
    return df.groupBy(one, two).agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(df: DataFrame, one: str, two: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two labelings."""
    cells = contingency(df, one, two)
    rows, cols = (cells.groupBy(k).agg(F.sum("n").alias("n")) for k in (one, two))
    total = cells.agg(F.sum("n").alias("t"), F.sum(_pairs(F.col("n"))).alias("index"))
    ri = rows.agg(F.sum(_pairs(F.col("n"))).alias("r"), F.sum(F.col("n") * F.log("n")).alias("hr"))
    ci = cols.agg(F.sum(_pairs(F.col("n"))).alias("c"), F.sum(F.col("n") * F.log("n")).alias("hc"))
    joint = cells.agg(F.sum(F.col("n") * F.log("n")).alias("hj"))
    x = total.join(ri).join(ci).join(joint)
    expected = F.try_divide(F.col("r") * F.col("c"), _pairs(F.col("t")))
    ari = F.try_divide(F.col("index") - expected, (F.col("r") + F.col("c")) / 2 - expected)
    t, log_t = F.col("t"), F.log("t")
    h1, h2 = log_t - F.col("hr") / t, log_t - F.col("hc") / t
    mutual = log_t + (F.col("hj") - F.col("hr") - F.col("hc")) / t
    return x.select(t.cast("long").alias("n"), F.coalesce(ari, F.lit(1.0)).alias("ari"), F.coalesce(F.try_divide(2 * mutual, h1 + h2), F.lit(1.0)).alias("nmi"))


def beta_prior(df: DataFrame, hits: str, trials: str, group: str, least: float = 0.5) -> DataFrame:
    """Beta parameters of each group's rates by the method of moments."""
    rates = df.where(F.col(trials) > 0).withColumn("__p", ratio(F.col(hits), F.col(trials)))
    m = rates.groupBy(group).agg(F.avg("__p").alias("mean"), F.var_samp("__p").alias("var"), F.count("*").alias("n"))
    strength = F.when(F.col("var") < 1e-12, 100.0).otherwise(F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1)
    usable = (F.col("n") >= 2) & (F.col("mean") > 0) & (F.col("mean") < 1) & (strength > 0)
    return m.select(group, F.when(usable, F.greatest(F.col("mean") * strength, F.lit(least))).otherwise(1.0).alias("alpha"), F.when(usable, F.greatest((1 - F.col("mean")) * strength, F.lit(least))).otherwise(1.0).alias("beta"))


def shrunken(df: DataFrame, hits: str, trials: str, group: str, least_trials: int = 3) -> DataFrame:
    """Posterior mean and variance of each row's rate under its group's Beta prior, and how far it shrank."""
    rows = df.where(F.col(trials) >= least_trials).join(beta_prior(df, hits, trials, group), group)
    a, b = F.col("alpha") + F.col(hits), F.col("beta") + F.col(trials) - F.col(hits)
    strength = F.col("alpha") + F.col("beta")
    return rows.withColumns({"raw": ratio(F.col(hits), F.col(trials)), "posterior": a / (a + b), "variance": a * b / ((a + b) ** 2 * (a + b + 1)), "shrinkage": strength / (strength + F.col(trials))})


def tarone(df: DataFrame, hits: str, trials: str, group: str) -> DataFrame:
    """Tarone's test of overdispersion against a common rate: Z and its one-sided p."""
    rows = df.where(F.col(trials) > 0).withColumn("__rate", F.sum(hits).over(Window.partitionBy(group)) / F.sum(trials).over(Window.partitionBy(group)))
    p = F.col("__rate")
    s = F.sum((F.col(hits) - F.col(trials) * p) ** 2 / (p * (1 - p)))
    n1, n2 = F.sum(trials), F.sum(F.col(trials) * (F.col(trials) - 1))
    out = rows.where((p > 0) & (p < 1)).groupBy(group).agg(((s - n1) / F.sqrt(2 * n2)).alias("z"))

    @F.pandas_udf("double")
    def upper_tail(z: pd.Series) -> pd.Series:
        return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2)))

    return out.withColumn("p", upper_tail("z"))


def kolmogorov(df: DataFrame, value: str, group: str, one: str, two: str) -> DataFrame:
    """Greatest distance between two groups' empirical distributions."""
    rows = df.where(F.col(group).isin(one, two) & F.col(value).isNotNull()).groupBy(value).agg(F.count(F.when(F.col(group) == one, 1)).alias("x"), F.count(F.when(F.col(group) == two, 1)).alias("y"))
    whole = rows.agg(F.sum("x").alias("all_x"), F.sum("y").alias("all_y"))  # one row
    upto = running(rows, [], [value], ["x", "y"]).crossJoin(F.broadcast(whole))
    gap = F.abs(F.try_divide(F.col("before_x") + F.col("x"), F.col("all_x")) - F.try_divide(F.col("before_y") + F.col("y"), F.col("all_y")))
    return upto.select(gap.alias("gap")).agg(F.max("gap").alias("ks"))
