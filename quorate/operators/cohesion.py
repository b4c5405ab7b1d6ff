"""Cohesion and party-unity indices over members, items and votes.

Ties of a majority: ``tie="Nay"`` (strictly more Yea than Nay makes Yea) or ``tie="Yea"``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_where, ratio
from ..plans.adapter import ABSENT, NAY, YEA

PARTIES = ("Republican", "Democrat")


def cast_votes(votes: DataFrame) -> DataFrame:
    return votes.where(F.col("choice").isin(YEA, NAY))


def party_counts(votes: DataFrame, members: DataFrame, how: str = "inner") -> DataFrame:
    """Yea and Nay votes of each party on each item; ``how="left"`` keeps voters without a member row."""
    joined = cast_votes(votes).join(members.select("voter", "party"), "voter", how)
    return joined.groupBy("item", "party").agg(count_where(F.col("choice") == YEA).alias("yea"), count_where(F.col("choice") == NAY).alias("nay"), F.count("*").alias("voters"))


def with_majority(counts: DataFrame, tie: str = "Nay") -> DataFrame:
    wins = F.col("yea") > F.col("nay") if tie == "Nay" else F.col("yea") >= F.col("nay")
    return counts.withColumn("majority", F.when(wins, YEA).otherwise(NAY)).withColumn("yea_share", ratio(F.col("yea"), F.col("voters")))


def rice(counts: DataFrame, least: int = 1) -> DataFrame:
    """|yea - nay| / (yea + nay); null below ``least`` voters."""
    return counts.withColumn("rice", F.when(F.col("voters") >= least, ratio(F.abs(F.col("yea") - F.col("nay")), F.col("voters"))))


def rice_summary(riced: DataFrame, fracture: float = 0.5) -> DataFrame:
    known = riced.where("rice is not null")
    return known.groupBy("party").agg(F.count("*").alias("n"), F.avg("rice").alias("mean"), F.median("rice").alias("median"), F.stddev_samp("rice").alias("std"), F.min("rice").alias("least"), F.max("rice").alias("most"), F.avg((F.col("rice") == 1).cast("int")).alias("perfect"), F.avg((F.col("rice") < fracture).cast("int")).alias("fractured"))


def rice_by_motion(riced: DataFrame, items: DataFrame) -> DataFrame:
    known = riced.where("rice is not null").join(items.select("item", "motion"), "item")
    return known.groupBy("motion", "party").agg(F.count("*").alias("n"), F.avg("rice").alias("mean"), F.median("rice").alias("median"), F.stddev_samp("rice").alias("std"))


def fractured_items(riced: DataFrame, below: float = 0.5) -> DataFrame:
    """Items on which the largest party (by mean voters) was split."""
    sizes = riced.groupBy("party").agg(F.avg("voters").alias("size"))
    largest = sizes.orderBy(F.desc("size"), "party").limit(1).select("party")
    return riced.join(F.broadcast(largest), "party", "left_semi").where(F.col("rice") < below)


def party_votes(counts: DataFrame, least: int = 2, tie: str = "Nay", floor: float = 0.01) -> DataFrame:
    """Both parties side by side, whether their majorities oppose, the margin and its closeness weight."""
    one, two = (with_majority(counts, tie).where(F.col("party") == p).select("item", *(F.col(c).alias(f"{k}_{c}") for c in ("yea", "nay", "voters", "majority"))) for p, k in zip(PARTIES, "rd", strict=True))
    both = one.join(two, "item", "full")
    oppose = (F.col("r_voters") >= least) & (F.col("d_voters") >= least) & (F.col("r_majority") != F.col("d_majority"))
    total = [reduce(lambda x, y: x + y, (F.coalesce(F.col(f"{k}_{c}"), F.lit(0)) for k in "rd")) for c in ("yea", "nay", "voters")]
    margin = ratio(F.abs(total[0] - total[1]), total[2])
    return both.withColumns({"party_vote": oppose, "margin": margin}).withColumn("weight", 1 / F.greatest("margin", F.lit(floor)))


def line_class(counts: DataFrame, high: float = 0.9) -> DataFrame:
    """party-line (over ``high`` against below 1 - ``high``), bipartisan (both on one side), else mixed."""
    shares = with_majority(counts).groupBy("item").agg(*(F.max(F.when(F.col("party") == p, F.col("yea_share"))).alias(k) for p, k in zip(PARTIES, "rd", strict=True)))
    low = 1 - high
    line = ((F.col("r") > high) & (F.col("d") < low)) | ((F.col("r") < low) & (F.col("d") > high))
    both = ((F.col("r") > high) & (F.col("d") > high)) | ((F.col("r") < low) & (F.col("d") < low))
    return shares.withColumn("kind", F.when(line, "party-line").when(both, "bipartisan").otherwise("mixed"))


def line_unity(votes: DataFrame, members: DataFrame, high: float = 0.9) -> DataFrame:
    """Share of votes with the own party's majority on party-line items."""
    counts = party_counts(votes, members)
    lines = line_class(counts, high).where("kind = 'party-line'").select("item")
    sides = with_majority(counts, "Yea").select("item", "party", "majority")
    own = cast_votes(votes).join(members.select("voter", "party"), "voter").join(lines, "item", "left_semi").join(sides, ["item", "party"])
    return own.groupBy("voter", "party").agg(F.count("*").alias("line_votes"), F.avg((F.col("choice") == F.col("majority")).cast("int")).alias("unity"))


def own_side(votes: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """Votes on party votes with the own and the other majority: (item, voter, party, choice, own, other, weight)."""
    sides = party_votes(party_counts(votes, members), least).where(F.coalesce("party_vote", F.lit(False))).select("item", "r_majority", "d_majority", "weight")
    joined = cast_votes(votes).join(members.select("voter", "party"), "voter").join(sides, "item")
    own = F.when(F.col("party") == PARTIES[0], F.col("r_majority")).otherwise(F.col("d_majority"))
    other = F.when(F.col("party") == PARTIES[0], F.col("d_majority")).otherwise(F.col("r_majority"))
    return joined.select("item", "voter", "party", "choice", own.alias("own"), other.alias("other"), "weight")


def unity(votes: DataFrame, members: DataFrame) -> DataFrame:
    """Unity, maverick rate, closeness-weighted maverick rate and its z-score within the party."""
    rows = own_side(votes, members).withColumn("defects", (F.col("choice") != F.col("own")).cast("int"))
    out = rows.groupBy("voter", "party").agg(F.count("*").alias("party_votes"), F.sum("defects").alias("defections"), (F.sum(F.col("defects") * F.col("weight")) / F.sum("weight")).alias("weighted_maverick"))
    out = out.withColumn("maverick", ratio(F.col("defections"), F.col("party_votes"))).withColumn("unity", 1 - F.col("maverick"))
    party = Window.partitionBy("party")
    n, std = F.count("*").over(party), F.stddev_samp("unity").over(party)
    return out.withColumn("z", F.when(n < 3, None).when(std < 1e-10, 0.0).otherwise((F.col("unity") - F.avg("unity").over(party)) / std))


def carey(votes: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """|yea - nay| over the whole roster of the party, absentees counted against unity."""
    roster = members.groupBy("party").agg(F.count("*").alias("members")).where(F.col("members") >= least)
    out = party_counts(votes, members).join(roster, "party")
    return out.withColumns({"carey": ratio(F.abs(F.col("yea") - F.col("nay")), F.col("members")), "absent": F.col("members") - F.col("yea") - F.col("nay")})


def effective_parties(members: DataFrame) -> DataFrame:
    shares = members.groupBy("chamber", "party").agg(F.count("*").alias("seats"))
    whole = F.sum("seats").over(Window.partitionBy("chamber"))
    return shares.withColumn("share", ratio(F.col("seats"), whole)).groupBy("chamber").agg((1 / F.sum(F.col("share") * F.col("share"))).alias("enp"), F.sum("seats").alias("seats"))


def effective_blocs(votes: DataFrame, members: DataFrame) -> DataFrame:
    """Effective number of (party, direction) blocs on each item."""
    blocs = cast_votes(votes).join(members.select("voter", "party"), "voter").groupBy("item", "party", "choice").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("item"))
    return blocs.withColumn("share", ratio(F.col("n"), whole)).groupBy("item").agg((1 / F.sum(F.col("share") * F.col("share"))).alias("enp"), F.count("*").alias("blocs"))


def bipartisanship(votes: DataFrame, members: DataFrame) -> DataFrame:
    rows = own_side(votes, members)
    return rows.groupBy("voter", "party").agg(F.count("*").alias("party_votes"), F.avg((F.col("choice") == F.col("other")).cast("int")).alias("bpi"))


def plus_minus(united: DataFrame) -> DataFrame:
    return united.withColumn("plus_minus", F.col("unity") - F.avg("unity").over(Window.partitionBy("party")))


def co_defection(votes: DataFrame, members: DataFrame, top: int = 20, shared: int = 3) -> DataFrame:
    """Pairs among the ``top`` defectors of the larger party that defect together at least ``shared`` times."""
    rows = own_side(votes, members).where("choice <> own")
    big = members.groupBy("party").count().orderBy(F.desc("count"), "party").limit(1).select("party")
    rows = rows.join(F.broadcast(big), "party", "left_semi")
    most = rows.groupBy("voter").count().orderBy(F.desc("count"), "voter").limit(top).select("voter")
    rows = rows.join(F.broadcast(most), "voter", "left_semi").select("item", "voter")
    pairs = rows.select("item", F.col("voter").alias("a")).join(rows.select("item", F.col("voter").alias("b")), "item").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= shared)


def perfect_partisans(votes: DataFrame, members: DataFrame, least: int = 50) -> DataFrame:
    sides = with_majority(party_counts(votes, members), "Yea").select("item", "party", "majority")
    own = cast_votes(votes).join(members.select("voter", "party"), "voter").join(sides, ["item", "party"])
    out = own.groupBy("voter", "party").agg(F.count("*").alias("n"), F.avg((F.col("choice") == F.col("majority")).cast("int")).alias("with_party"))
    return out.withColumn("perfect", (F.col("with_party") == 1) & (F.col("n") >= least))


def strategic_absence(votes: DataFrame, members: DataFrame, flag: float = 2.0, least: int = 3) -> DataFrame:
    """Absence on party votes against absence overall."""
    sides = party_votes(party_counts(votes, members)).where(F.coalesce("party_vote", F.lit(False))).select("item", F.lit(1).alias("line"))
    rows = votes.join(members.select("voter", "party"), "voter").join(sides, "item", "left")
    away, line = F.col("choice") == ABSENT, F.col("line").isNotNull()
    out = rows.groupBy("voter", "party").agg(F.avg(away.cast("int")).alias("overall"), F.avg(F.when(line, away.cast("int"))).alias("on_line"), count_where(line & away).alias("absences"))
    out = out.withColumn("ratio", ratio(F.col("on_line"), F.col("overall")))
    return out.withColumn("strategic", F.coalesce((F.col("ratio") >= flag) & (F.col("absences") >= least), F.lit(False)))


def participation(votes: DataFrame, members: DataFrame) -> DataFrame:
    """Yea and Nay votes over the items that any member of the chamber faced."""
    rows = votes.join(members.select("voter", "party", "chamber"), "voter")
    totals = rows.groupBy("chamber").agg(F.countDistinct("item").alias("items"))
    out = rows.groupBy("voter", "party", "chamber").agg(count_where(F.col("choice") != ABSENT).alias("cast"), F.count("*").alias("listed"))
    return out.join(totals, "chamber").withColumn("rate", ratio(F.col("cast"), F.col("items")))


def choice_breakdown(votes: DataFrame, members: DataFrame) -> DataFrame:
    """Choices by party with subtotals and a total row."""
    rows = votes.join(members.select("voter", "party"), "voter")
    return rows.rollup("party", "choice").agg(F.count("*").alias("n"))


def loyalty(votes: DataFrame, members: DataFrame, contested: float = 0.1) -> DataFrame:
    """Agreement with the median side of the own party on items that the party contested."""
    sides = with_majority(party_counts(votes, members))
    sides = sides.where((F.least(F.col("yea_share"), 1 - F.col("yea_share")) >= contested)).select("item", "party", F.when(F.col("yea_share") > 0.5, YEA).otherwise(NAY).alias("side"))
    own = cast_votes(votes).join(members.select("voter", "party"), "voter").join(sides, ["item", "party"])
    return own.groupBy("voter", "party").agg(F.count("*").alias("contested"), F.avg((F.col("choice") == F.col("side")).cast("int")).alias("loyalty"))


def expected_rice(counts: DataFrame) -> DataFrame:
    """Rice expected of coin flips in a party of that size, and the excess over it.

    E|2X - n| / n for X ~ Binomial(n, 1/2) is C(2m, m) / 4**m with m = n // 2 for odd n and even n alike.
    """
    m = F.floor(F.col("voters") / 2)
    chance = F.exp(F.aggregate(F.when(m > 0, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda a, k: a + F.log((2 * k - 1) / (2 * k))))
    return rice(counts).withColumn("chance", chance).withColumn("excess", F.col("rice") - F.col("chance"))


def item_polarization(votes: DataFrame, members: DataFrame, least: int = 10) -> DataFrame:
    shares = with_majority(party_counts(votes, members)).groupBy("item").agg(*(F.max(F.when(F.col("party") == p, F.col("yea_share"))).alias(k) for p, k in zip(PARTIES, ("r_share", "d_share"), strict=True)), F.sum("voters").alias("voters"))
    return shares.where((F.col("voters") >= least) & F.col("r_share").isNotNull() & F.col("d_share").isNotNull()).withColumn("polarization", F.abs(F.col("r_share") - F.col("d_share")))
