"""Item lifecycles: stage classification and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stages in order of test; a status takes the first stage one of whose phrases it holds.
STAGES = [
    ("Introduced", ("introduced",)),
    ("Committee Referral", ("referred to committee",)),
    ("Hearing", ("hearing", "scheduled for hearing")),
    ("Committee Report", ("committee report recommending",)),
    ("Committee of the Whole", ("committee of the whole",)),
    ("Floor Vote", ("final action", "emergency final action", "roll call")),
    ("Cross-Chamber", ("received by", "transmitted to")),
    ("Signed into Law", ("approved by governor",)),
    ("Vetoed", ("vetoed by governor", "line item veto")),
    ("Governor", ("enrolled and presented",)),
]
#: Stages after which a bill that goes no further hasn't died: it has passed a floor, or waits for or has the governor's word.
TERMINAL = ("Floor Vote", "Cross-Chamber", "Governor", "Signed into Law", "Vetoed")


def classify(status: Column, stages=STAGES) -> Column:
    text, out = F.lower(status), None
    for name, words in stages:
        hit = None
        for w in words:
            hit = text.contains(w) if hit is None else hit | text.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Other")


def stage_counts(actions: DataFrame, stages=STAGES) -> DataFrame:
    return actions.withColumn("stage", classify(F.col("status"), stages)).groupBy("stage").agg(F.count("*").alias("n"), F.countDistinct("bill").alias("bills"))


def transitions(actions: DataFrame, stages=STAGES, terminal=TERMINAL) -> DataFrame:
    """Counts of (source, target) over each bill's stages, repeats in a row collapsed.

    A bill whose last stage isn't terminal goes from there to Died.
    """
    order = Window.partitionBy("bill").orderBy("ts", "event_id")
    steps = actions.withColumn("stage", classify(F.col("status"), stages)).withColumn("before", F.lag("stage").over(order))
    steps = steps.where("before is null or before <> stage").withColumn("target", F.lead("stage").over(order))
    moves = steps.select(F.col("stage").alias("source"), F.when(F.col("target").isNull() & ~F.col("stage").isin(*terminal), "Died").otherwise(F.col("target")).alias("target"))
    return moves.where("target is not null").groupBy("source", "target").agg(F.count("*").alias("n"))


def durations(actions: DataFrame) -> DataFrame:
    """Days from first to last action, and actions, of each bill."""
    return actions.groupBy("bill").agg(F.count("*").alias("actions"), F.datediff(F.max("ts"), F.min("ts")).alias("days"), F.countDistinct("status").alias("kinds"))


#: Words of result texts that say that an item failed or passed.
FAILED, PASSED, UPHELD = r"\b(not\s+passed|failed|rejected)\b", r"\b(passed|adopted|prevailed|concurred)\b", "sustained"


def outcome(text: Column) -> Column:
    """Whether a result text says that the item passed: failures are tested first; unknown is null."""
    t = F.lower(text)
    failed = t.rlike(FAILED) | t.contains(UPHELD)
    passed = t.rlike(PASSED)
    return F.when(failed, False).when(passed, True)
