"""Record linkage: name normalisation, staged matching, positional pairing, keyed merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_name(name: Column) -> Column:
    """Lower case, without a trailing role after a dash, suffixes, dots and spare white space; "Last, First" turned."""
    text = F.lower(F.trim(F.regexp_replace(name, r"\s+-\s+.*$", "")))
    turned = F.when(text.contains(","), F.concat_ws(" ", F.trim(F.substring_index(text, ",", -1)), F.trim(F.substring_index(text, ",", 1)))).otherwise(text)
    bare = F.regexp_replace(F.regexp_replace(turned, r"\.", ""), r"\s+(jr|sr|ii|iii|iv)$", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def last_name(name: Column) -> Column:
    return F.substring_index(normal_name(name), " ", -1)


def normal_bill(bill: Column) -> Column:
    """"S Sub for Sub for HB 2007" to "HB 2007", whatever the case of the prefixes."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(bill), r"(?i)^(?:(?:[SH] )?Sub for )+", ""), r"\s+", " "))


def staged(left: DataFrame, right: DataFrame, stages: list[tuple[str, list[str]]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, stage): matches by the first stage whose keys are equal and unique on both sides.

    Rows that a stage matched take no part in later ones.
    """
    out = None
    for stage, keys in stages:
        sides = []
        for side, key in ((left, left_id), (right, right_id)):
            known = side.dropna(subset=keys)
            sides.append(known.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n = 1").select(key, *keys))
        found = sides[0].join(sides[1], keys).select(left_id, right_id, F.lit(stage).alias("stage"))
        out = found if out is None else out.unionAll(found)
        left, right = left.join(found, left_id, "left_anti"), right.join(found, right_id, "left_anti")
    return out


def unmatched(left: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    return left.join(matches, key, "left_anti")


def positional(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Pairs the i-th row of a key on one side with the i-th on the other; rows left over stay with null partners."""
    a = left.select(*keys, F.col(order).alias("left_at")).withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("left_at")))
    b = right.select(*keys, F.col(order).alias("right_at")).withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("right_at")))
    return a.join(b, [*keys, "i"], "full")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in the given order."""
    return rows.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__i = 1").drop("__i")


def merge_keyed(old: DataFrame, new: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """``old`` with all rows of the labels that ``new`` holds replaced by ``new``; ``new`` is taken once per key."""
    kept = old.join(new.select(label).distinct(), label, "left_anti")
    return kept.unionByName(first_wins(new, keys, keys), allowMissingColumns=True)
