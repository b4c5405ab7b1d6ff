"""Filtered and paged resource queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def find_members(members: DataFrame, chamber: str | None = None, party: str | None = None, search: str | None = None) -> DataFrame:
    out = members
    if chamber:
        out = out.where(F.col("chamber") == chamber)
    if party:
        out = out.where(F.col("party") == party)
    if search:
        s = search.lower()
        out = out.where(F.lower("full_name").contains(s) | F.lower("voter").contains(s))
    return out


def find_items(items: DataFrame, chamber: str | None = None, bill: str | None = None, date_from: str | None = None, date_to: str | None = None, search: str | None = None) -> DataFrame:
    out = items
    for column, value in (("chamber", chamber), ("bill", bill)):
        if value:
            out = out.where(F.col(column) == value)
    if date_from:
        out = out.where(F.col("day") >= F.lit(date_from).cast("date"))
    if date_to:
        out = out.where(F.col("day") <= F.lit(date_to).cast("date"))
    if search:
        s = search.lower()
        out = out.where(F.lower("bill").contains(s) | F.lower("motion").contains(s))
    return out


def item_detail(items: DataFrame, votes: DataFrame, members: DataFrame, item: int) -> DataFrame:
    one = items.where(F.col("item") == item)
    return one.join(votes.where(F.col("item") == item), "item").join(members.select("voter", "full_name", "party"), "voter")


def session_counts(scores: DataFrame) -> DataFrame:
    """Persons and score rows of each session, counted apart so that neither multiplies the other."""
    return scores.groupBy("session").agg(F.countDistinct("person").alias("persons"), F.count("*").alias("rows"))
