"""Fitted classifiers of votes and of passage: logistic regression, boosted trees, random forest.

Rates that serve as features are learned from training rows alone, and for a training row from other
parts of them, so neither held-out nor own outcomes leak.  A row's part is a hash of its key: the
same on every run, and both classes are dealt alike.  Metrics reach the driver (one row a model and
fold), features and predictions don't.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import predict

VOTE_FEATURES = ["voter_rate", "item_rate", "party_item_rate", "day_of_session", "is_sb", "is_hb"]
PASSAGE_FEATURES = ["day_of_session", "is_sb", "is_hb", "number"]
METRICS = ["accuracy", "auc", "precision", "recall", "f1", "brier", "log_loss", "baseline"]
SCHEMA = "model string, part string, n long, " + ", ".join(f"{m} double" for m in METRICS)


def part_of(*key: str, seed: int = 42) -> Column:
    """A number in [0, 1) from a row's key."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 20)) / float(1 << 20)


def held_rates(rows: DataFrame, held: Column, inner: int = 10) -> DataFrame:
    """``rows`` (voter, item, party, y, ...) with ``held`` and the rates learned from rows that aren't held.

    Training rows are dealt to ``inner`` parts (column ``deal``) and get the rates of the other parts: a rate
    that leaves out one row only tells that row's outcome by how far it falls.  Where nothing is known a rate is 0.5.
    """
    out = rows.withColumns({"held": held, "deal": F.pmod(F.xxhash64(F.lit(11), "voter", "item"), F.lit(inner))})
    train = out.where(~F.col("held"))
    for name, keys in (("voter_rate", ["voter"]), ("item_rate", ["item"]), ("party_item_rate", ["item", "party"])):
        dealt = train.groupBy(*keys, "deal").agg(F.sum("y").alias("s"), F.count("*").alias("k"))
        total = dealt.groupBy(*keys).agg(F.sum("s").alias("ts"), F.sum("k").alias("tk"))
        own = lambda c: F.when(F.col("held"), 0).otherwise(F.coalesce(F.col(c), F.lit(0)))
        rate = F.try_divide(F.col("ts") - own("s"), F.col("tk") - own("k"))
        out = out.join(dealt, [*keys, "deal"], "left").join(total, keys, "left").withColumn(name, F.coalesce(rate, F.lit(0.5))).drop("s", "k", "ts", "tk")
    return out


def vote_rows(coo: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """One row per vote, with the features of its item."""
    return coo.join(members.select("voter", "party"), "voter").join(predict.item_features(items), "item")


def passage_rows(votes: DataFrame, items: DataFrame) -> DataFrame:
    """One row per item with a Yea or Nay: ``y`` is 1 where Yeas outnumber Nays."""
    tally = votes.groupBy("item").agg(F.count(F.when(F.col("choice") == "Yea", 1)).alias("yea"), F.count(F.when(F.col("choice") == "Nay", 1)).alias("nay"))
    passed = tally.where("yea + nay > 0").select("item", (F.col("yea") > F.col("nay")).cast("int").alias("y"))
    return passed.join(predict.item_features(items), "item").join(items.select("item", "day"), "item")


def early(rows: DataFrame, share: float = 0.7) -> Column:
    """True for the rows of the first days that hold at most ``share`` of all rows; whole days, never a part of one."""
    days = rows.groupBy("day").agg(F.count("*").alias("n"))
    over = Window.orderBy("day")  # one row a day
    upto = days.withColumn("upto", F.sum("n").over(over))
    total = days.agg(F.sum("n").alias("total"))
    last = upto.join(F.broadcast(total)).where(F.col("upto") <= share * F.col("total")).agg(F.max("day").alias("day")).first()["day"]
    return F.lit(False) if last is None else F.col("day") <= F.lit(last)


def estimators(rows: int, rounds: int = 20, trees: int = 20, seed: int = 42) -> dict[str, Estimator]:
    """The three models.  The penalty of the logistic regression is that of one unit in the sum of losses over ``rows``."""
    columns = {"labelCol": "y", "featuresCol": "features"}
    return {
        "logistic regression": LogisticRegression(maxIter=100, regParam=1 / max(rows, 1), standardization=False, **columns),
        "boosted trees": GBTClassifier(maxIter=rounds, maxDepth=6, stepSize=0.1, seed=seed, cacheNodeIds=False, **columns),
        "random forest": RandomForestClassifier(numTrees=trees, maxDepth=10, seed=seed, **columns),
    }


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows)


def predicted(model: Model, rows: DataFrame) -> DataFrame:
    """``rows`` with ``p``, the probability of 1."""
    return model.transform(rows).withColumn("p", F.round(vector_to_array("probability")[1], 12)).drop("features", "rawPrediction", "probability", "prediction")


def measured(scored: DataFrame) -> dict[str, float]:
    row = predict.scores(scored).first().asDict() | predict.auc(scored).first().asDict()
    return {k: row[k] for k in ["n", *METRICS]}


def usable(train: DataFrame, least: int) -> int:
    """Training rows, or 0 where they are fewer than ``least`` or all of one class."""
    row = train.agg(F.count("*").alias("n"), F.min("y").alias("a"), F.max("y").alias("b")).first()
    return row["n"] if row["n"] >= least and row["a"] != row["b"] else 0


def evaluate(parts: list[tuple[str, DataFrame]], features: list[str], least: int = 20, fit: Callable = estimators, parallel: int = 4) -> list[tuple]:
    """Metrics of each model on the held rows of each part (name, rows with ``held``), ``parallel`` parts at a time.

    Parts without enough training rows, with one class or with nothing held give no row.
    """

    def one(part: str, rows: DataFrame) -> list[tuple]:
        out = []
        # in one order on every run, since the forest samples rows by their place
        ready = assembled(rows.sortWithinPartitions("y", *features), features).select("y", "held", "features").persist(StorageLevel.DISK_ONLY)
        try:
            train, test = ready.where(~F.col("held")), ready.where("held")
            n = usable(train, least)
            if n and not test.isEmpty():
                for name, estimator in fit(n).items():
                    m = measured(predicted(estimator.fit(train), test))
                    out.append((name, part, m["n"], *(m[k] for k in METRICS)))
        finally:
            ready.unpersist()
        return out

    if not parts:
        return []
    session = parts[0][1].sparkSession
    with ThreadPoolExecutor(parallel) as pool:
        return [row for done in [pool.submit(inheritable_thread_target(session)(one), *part) for part in parts] for row in done.result()]


def vote_models(coo: DataFrame, members: DataFrame, items: DataFrame, folds: int = 5, test: float = 0.2, **sizes) -> DataFrame:
    """(model, part, n, metrics): a held-out share named ``held out`` and folds of the other rows named ``fold 1`` and on."""
    rows = vote_rows(coo, members, items).withColumn("u", part_of("voter", "item"))

    others, fold = rows.where(F.col("u") >= test), F.pmod(F.xxhash64(F.lit(7), "voter", "item"), F.lit(folds))
    parts = [("held out", held_rates(rows, F.col("u") < test)), *((f"fold {i + 1}", held_rates(others, fold == i)) for i in range(folds))]
    return coo.sparkSession.createDataFrame(evaluate(parts, VOTE_FEATURES, fit=lambda n: estimators(n, **sizes)), SCHEMA)


def passage_models(votes: DataFrame, items: DataFrame, test: float = 0.2, **sizes) -> DataFrame:
    """(model, part, n, metrics) of passage by item: a held-out share, and ``later`` days predicted by the first 70 %."""
    rows = passage_rows(votes, items)

    parts = [("held out", rows.withColumn("held", part_of("item") < test)), ("later", rows.withColumn("held", ~early(rows)))]
    return votes.sparkSession.createDataFrame(evaluate(parts, PASSAGE_FEATURES, fit=lambda n: estimators(n, **sizes)), SCHEMA)


def held_out_votes(coo: DataFrame, members: DataFrame, items: DataFrame, test: float = 0.2, **sizes) -> DataFrame:
    """(voter, item, party, y, p): the held-out votes as the boosted trees score them.  Empty where nothing can be learned."""
    rows = held_rates(vote_rows(coo, members, items).withColumn("u", part_of("voter", "item")), F.col("u") < test)
    ready = assembled(rows, VOTE_FEATURES)
    train = ready.where(~F.col("held")).select("y", "features").persist(StorageLevel.DISK_ONLY)
    try:
        n = usable(train, 20)
        model = estimators(n, **sizes)["boosted trees"].fit(train) if n else None
    finally:
        train.unpersist()
    held = ready.where("held").select("voter", "item", "party", "y", "features")
    return held.limit(0).drop("features").withColumn("p", F.lit(0.0)) if model is None else predicted(model, held)


def importances(coo: DataFrame, members: DataFrame, items: DataFrame, **sizes) -> DataFrame:
    """(model, feature, weight): coefficients of the logistic regression, shares of the split gain of the trees."""
    rows = assembled(held_rates(vote_rows(coo, members, items), F.lit(False)), VOTE_FEATURES).select("y", "features").persist(StorageLevel.DISK_ONLY)
    out = []
    try:
        n = usable(rows, 20)
        for name, estimator in estimators(n, **sizes).items() if n else ():
            model = estimator.fit(rows)
            weights = model.coefficients if name == "logistic regression" else model.featureImportances
            out += [(name, f, float(w)) for f, w in zip(VOTE_FEATURES, weights.toArray(), strict=True)]
    finally:
        rows.unpersist()
    return coo.sparkSession.createDataFrame(out, "model string, feature string, weight double")
