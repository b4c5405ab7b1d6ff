"""Networks of a part of the votes or members, and the two-sided graph of members and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_where, ratio
from .cohesion import PARTIES


def distances(pairs: DataFrame) -> DataFrame:
    """1 - kappa, not below 0; pairs without kappa get the greatest distance there is."""
    most = pairs.agg(F.max(1 - F.col("kappa")).alias("most"))  # one row
    d = F.coalesce(1 - F.col("kappa"), F.col("most"))
    return pairs.crossJoin(F.broadcast(most)).select("a", "b", F.greatest(d, F.lit(0.0)).alias("distance"))


def with_ends(edges: DataFrame, members: DataFrame, *columns: str) -> DataFrame:
    """Edges with members' columns at both ends, suffixed _a and _b."""
    for end in ("a", "b"):
        side = members.select(F.col("voter").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns))
        edges = edges.join(side, end)
    return edges


def between(edges: DataFrame, members: DataFrame, column: str, same: bool) -> DataFrame:
    """Edges inside of one group of members, or between two."""
    ends = with_ends(edges, members, column)
    inside = F.col(f"{column}_a") == F.col(f"{column}_b")
    return ends.where(inside if same else ~inside).select("a", "b", F.least(f"{column}_a", f"{column}_b").alias("one"), F.greatest(f"{column}_a", f"{column}_b").alias("two"), "weight")


def centrality_by(degrees: DataFrame, members: DataFrame, column: str) -> DataFrame:
    rows = degrees.join(members.select("voter", column), "voter")
    return rows.groupBy(column).agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in ("degree", "strength") for k, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_samp))))


def extreme_weights(edges: DataFrame, points: DataFrame, top: int = 2) -> DataFrame:
    """Ties inside of their party of the ``top`` majority members furthest from zero, against the party's median tie."""
    main = points.groupBy("party").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "party").limit(1).select("party")
    own = points.join(F.broadcast(main), "party")
    far = own.orderBy(F.desc(F.abs("xi")), "voter").limit(top).select("voter")
    inside = between(edges, own, "party", True)
    whole = inside.agg(F.median("weight").alias("party_median"))  # one row
    ends = inside.select(F.col("a").alias("voter"), "weight").unionAll(inside.select("b", "weight"))
    mine = ends.join(F.broadcast(far), "voter").groupBy("voter").agg(F.count("*").alias("ties"), F.avg("weight").alias("mean"), F.median("weight").alias("median"), F.min("weight").alias("least"))
    return mine.crossJoin(F.broadcast(whole))


def two_sided(votes: DataFrame) -> DataFrame:
    """Size and density of the graph that joins members to the items they voted Yea on."""
    yea = votes.where("choice = 'Yea'")
    out = yea.agg(F.count("*").alias("edges"), F.countDistinct("voter").alias("voters"), F.countDistinct("item").alias("items"))
    return out.withColumns({"density": ratio(F.col("edges"), F.col("voters") * F.col("items")), "mean_voter_degree": ratio(F.col("edges"), F.col("voters")), "mean_item_degree": ratio(F.col("edges"), F.col("items"))})


def item_groups(shares: DataFrame, items: DataFrame, group: Column) -> DataFrame:
    """Mean party shares and polarization of groups of items; shares has item, r_share, d_share, polarization."""
    rows = shares.join(items, "item").withColumn("kind", group)
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.avg("r_share").alias("r_share"), F.avg("d_share").alias("d_share"), F.avg("polarization").alias("polarization"))


def composition(points: DataFrame, community: Column) -> DataFrame:
    r, d = (count_where(F.col("party") == p) for p in PARTIES)
    return points.withColumn("community", community).groupBy("community").agg(F.count("*").alias("n"), r.alias("r"), d.alias("d"), F.avg("xi").alias("mean"), F.min("xi").alias("least"), F.max("xi").alias("most"))
