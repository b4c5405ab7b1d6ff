"""Maps generic tables onto voter x item x choice.

members(voter, full_name, party, chamber, district), items(item, bill, motion, chamber, day),
votes(item, voter, choice), sessions(person, session, score), actions(bill, ts, status).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

YEA, NAY, ABSENT = "Yea", "Nay", "Absent and Not Voting"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slug(key: str) -> Column:
    return F.concat(F.when(F.col(key) % 4 == 0, "sen_").otherwise("rep_"), F.col(key).cast("string"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(
        slug("s_suppkey").alias("voter"),
        F.col("s_name").alias("full_name"),
        F.when(F.col("n_regionkey") % 2 == 0, "Republican").otherwise("Democrat").alias("party"),
        F.when(F.col("s_suppkey") % 4 == 0, "Senate").otherwise("House").alias("chamber"),
        F.col("s_nationkey").alias("district"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"),
        F.concat(F.when(F.col("p_size") % 2 == 0, "SB ").otherwise("HB "), F.col("p_partkey").cast("string")).alias("bill"),
        F.col("p_brand").alias("motion"),
        F.when(F.col("p_size") % 2 == 0, "Senate").otherwise("House").alias("chamber"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 500).cast("int")).alias("day"),
    )


def votes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a vote, repeats included."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey"), F.col("l_returnflag"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One choice per (item, voter): of repeats the greatest flag."""
    once = votes_raw(spark, sf_dir).groupBy("item", "l_suppkey").agg(F.max("l_returnflag").alias("flag"))
    choice = F.when(F.col("flag") == "R", YEA).when(F.col("flag") == "A", NAY).otherwise(ABSENT)
    return once.select("item", slug("l_suppkey").alias("voter"), choice.alias("choice"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.year("o_orderdate").alias("session"), "o_totalprice")
    return rows.groupBy("person", "session").agg(F.avg("o_totalprice").alias("score"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("bill"), "ts", F.col("event_type").alias("status"), "event_id")


# The same views for an SQL engine, as common table expressions.
SQL = {
    "members": """members AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'sen_' ELSE 'rep_' END || CAST(s_suppkey AS VARCHAR) AS voter, s_name AS full_name,
        CASE WHEN n_regionkey % 2 = 0 THEN 'Republican' ELSE 'Democrat' END AS party, CASE WHEN s_suppkey % 4 = 0 THEN 'Senate' ELSE 'House' END AS chamber,
        s_nationkey AS district FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "items": """items AS (SELECT p_partkey AS item, CASE WHEN p_size % 2 = 0 THEN 'SB ' ELSE 'HB ' END || CAST(p_partkey AS VARCHAR) AS bill, p_brand AS motion,
        CASE WHEN p_size % 2 = 0 THEN 'Senate' ELSE 'House' END AS chamber, CAST(DATE '2024-01-01' + CAST(p_partkey % 500 AS INTEGER) AS DATE) AS day FROM part)""",
    "votes": """votes AS (SELECT l_partkey AS item, CASE WHEN l_suppkey % 4 = 0 THEN 'sen_' ELSE 'rep_' END || CAST(l_suppkey AS VARCHAR) AS voter,
        CASE max(l_returnflag) WHEN 'R' THEN 'Yea' WHEN 'A' THEN 'Nay' ELSE 'Absent and Not Voting' END AS choice FROM lineitem GROUP BY l_partkey, l_suppkey)""",
    "sessions": """sessions AS (SELECT o_custkey AS person, CAST(year(o_orderdate) AS INTEGER) AS session, avg(o_totalprice) AS score FROM orders GROUP BY 1, 2)""",
    "actions": """actions AS (SELECT user_id AS bill, ts, event_type AS status, event_id FROM events)""",
}


def with_views(*names: str, more: str = "") -> str:
    return "WITH " + ",\n".join([SQL[n] for n in names] + ([more] if more else [])) + "\n"
