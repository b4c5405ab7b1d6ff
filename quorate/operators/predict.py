"""Features of votes and items, splits, baselines, errors and surprises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio


def fold(key: Column, folds: int = 5) -> Column:
    """A row's fold by a hash of its key, the same on every run and cluster."""
    return F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")


def item_features(items: DataFrame, prefixes=("SB", "HB")) -> DataFrame:
    prefix = F.regexp_extract("bill", r"^([A-Z]+)", 1)
    starts = items.groupBy(F.col("chamber").alias("__chamber")).agg(F.min("day").alias("__start"))  # one row a chamber
    return items.join(F.broadcast(starts), F.col("chamber").eqNullSafe(F.col("__chamber"))).select("item", "bill", prefix.alias("prefix"), F.regexp_extract("bill", r"(\d+)$", 1).cast("long").alias("number"), F.datediff("day", "__start").alias("day_of_session"), *((prefix == p).cast("int").alias(f"is_{p.lower()}") for p in prefixes))


def vote_features(coo: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """One row per vote: outcome, the voter's and party's rate without this vote, and the item's features.

    Rates leave the row's own vote out, so the outcome doesn't leak into them.
    """
    rows = coo.join(members.select("voter", "party"), "voter")

    def others(*keys: str) -> Column:
        over = Window.partitionBy(*keys)
        return F.try_divide(F.sum("y").over(over) - F.col("y"), F.count("*").over(over) - 1)

    rates = rows.select("voter", "item", "party", "y", others("voter").alias("voter_rate"), others("item").alias("item_rate"), others("item", "party").alias("party_item_rate"))
    return rates.join(item_features(items), "item").dropna(subset=["voter_rate", "item_rate", "party_item_rate"])


def naive_score(features: DataFrame) -> DataFrame:
    """A plain probability of Yea: the mean of the leave-one-out rates."""
    return features.withColumn("p", (F.col("voter_rate") + F.col("item_rate") + F.col("party_item_rate")) / 3)


def scores(scored: DataFrame, *group: str) -> DataFrame:
    """Accuracy, precision, recall, F1, Brier score, log loss and the majority baseline."""
    hit = (F.col("p") >= 0.5).cast("int")
    clipped = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("p")))
    tp, fp, fn = (F.sum((a & b).cast("int")) for a, b in ((hit == 1, F.col("y") == 1), (hit == 1, F.col("y") == 0), (hit == 0, F.col("y") == 1)))
    out = scored.groupBy(*group).agg(F.count("*").alias("n"), F.avg((hit == F.col("y")).cast("int")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.avg(-(F.col("y") * F.log(clipped) + (1 - F.col("y")) * F.log(1 - clipped))).alias("log_loss"), F.greatest(F.avg("y"), 1 - F.avg("y")).alias("baseline"))
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def auc(scored: DataFrame, bins: int = 4096) -> DataFrame:
    """Area under the ROC curve by counts per distinct score, so ties count half.

    Scores are summed by range first: only the totals of the ``bins`` ranges meet in one task, and
    the order inside a range is found in the task of that range.
    """
    by = scored.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    by = by.withColumn("bin", F.floor(F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0)) * bins))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    lower = by.groupBy("bin").agg(F.sum("neg").alias("neg")).select("bin", F.coalesce(F.sum("neg").over(before), F.lit(0)).alias("lower"))
    below = F.sum("neg").over(Window.partitionBy("bin").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    parts = by.join(F.broadcast(lower), "bin").withColumn("won", F.col("pos") * (F.col("lower") + F.coalesce(below, F.lit(0)) + F.col("neg") / 2))
    return parts.agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).select(F.try_divide("won", F.col("pos") * F.col("neg")).alias("auc"))


def surprises(scored: DataFrame, top: int = 20) -> DataFrame:
    """Wrong predictions made with the most confidence."""
    wrong = scored.where((F.col("p") >= 0.5).cast("int") != F.col("y")).withColumn("error", F.round(F.abs(F.col("p") - F.col("y")), 9))
    return wrong.select("voter", "item", "party", "y", "error").orderBy(F.desc("error"), "voter", "item").limit(top)


def hardest(scored: DataFrame, least: int = 10, top: int = 8, shown: int = 5) -> DataFrame:
    """Voters predicted worst, with their items of the greatest error."""
    rows = scored.withColumns({"ok": ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int"), "error": F.round(F.abs(F.col("p") - F.col("y")), 9)})
    by = rows.groupBy("voter", "party").agg(F.count("*").alias("n"), F.avg("ok").alias("accuracy")).where(F.col("n") >= least).orderBy("accuracy", "voter").limit(top)
    order = Window.partitionBy("voter").orderBy(F.desc("error"), "item")
    worst = rows.join(F.broadcast(by.select("voter")), "voter", "left_semi").withColumn("i", F.row_number().over(order)).where(F.col("i") <= shown)
    lists = worst.groupBy("voter").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("i", "item"))), lambda s: s["item"].cast("string"))).alias("items"))
    return by.join(lists, "voter")
