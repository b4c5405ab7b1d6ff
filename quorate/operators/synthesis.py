"""What analyses say together about members: positions, detectors, clusters and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_where, guarded_corr, ratio
from .ranks import with_ranks
from .cohesion import PARTIES


def positions(encoded: DataFrame, members: DataFrame) -> DataFrame:
    """Members with xi, the z-score of their Yea rate, and n, their votes."""
    rates = encoded.groupBy("voter").agg(F.avg("y").alias("rate"), F.count("*").alias("n"))
    whole = rates.agg(F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("std"))  # one row
    xi = F.round(F.try_divide(F.col("rate") - F.col("mean"), F.col("std")), 9)
    return rates.crossJoin(F.broadcast(whole)).select("voter", "n", xi.alias("xi")).join(members, "voter")


def horseshoe(points: DataFrame) -> DataFrame:
    """Per chamber whether the parties' positions fold: Democrats above zero, Republicans below the Democrats' mean, overlap."""
    one, two = PARTIES
    sides = points.groupBy("chamber").agg(F.min(F.when(F.col("party") == one, F.col("xi"))).alias("r_least"), F.max(F.when(F.col("party") == two, F.col("xi"))).alias("d_most"), F.round(F.avg(F.when(F.col("party") == two, F.col("xi"))), 9).alias("d_mean"))
    rows = points.join(sides, "chamber")
    out = rows.groupBy("chamber", "r_least", "d_mean").agg(
        F.avg(F.when(F.col("party") == two, (F.col("xi") > 0).cast("int"))).alias("d_above"),
        F.avg(F.when(F.col("party") == one, F.col("xi") <= F.col("d_most")).when(F.col("party") == two, F.col("xi") >= F.col("r_least")).cast("int")).alias("overlap"),
    )
    found = (F.round("d_above", 9) > 0.2) | (F.col("r_least") < F.col("d_mean")) | (F.round("overlap", 9) > 0.3)
    return out.select("chamber", "d_above", "overlap", F.coalesce(found, F.lit(False)).alias("detected"))


def supermajority(members: DataFrame, share: float = 0.7) -> DataFrame:
    seats = members.groupBy("chamber", "party").agg(F.count("*").alias("seats"))
    total = seats.groupBy("chamber").agg(F.sum("seats").alias("total"))
    out = seats.join(total, "chamber").withColumn("share", ratio(F.col("seats"), F.col("total")))
    return out.withColumn("supermajority", F.round("share", 9) >= share)


def cross_party_agreement(encoded: DataFrame, members: DataFrame, low: float = 0.1, voters: int = 3, least: int = 5) -> DataFrame:
    """Share of votes with the other party's majority (ties are Yea) on items that both parties contest."""
    rows = encoded.join(members.select("voter", "party"), "voter")
    by = rows.groupBy("item", "party").agg(F.round(F.avg("y"), 9).alias("share"), F.count("*").alias("voters"))
    open_ = by.where((F.col("voters") >= voters) & F.col("share").between(low, 1 - low))
    one, two = (open_.where(F.col("party") == p).select("item", F.col("share").alias(k)) for p, k in zip(PARTIES, ("r", "d"), strict=True))
    both = one.join(two, "item")
    other = F.when(F.col("party") == PARTIES[0], F.col("d")).when(F.col("party") == PARTIES[1], F.col("r"))
    judged = rows.join(both, "item").withColumn("same", (F.col("y") == (other >= 0.5).cast("int")).cast("int")).where("same is not null")
    return judged.groupBy("voter", "party").agg(F.count("*").alias("n"), F.avg("same").alias("agreement")).where(F.col("n") >= least)


def rank_comparison(df: DataFrame, key: str, one: str, two: str, beyond: int = 10) -> DataFrame:
    """Descending ranks of two scores, ties averaged and cut to whole numbers, and how far they lie apart."""
    rows = df.where(F.col(one).isNotNull() & F.col(two).isNotNull()).withColumns({"__one": -F.col(one), "__two": -F.col(two)})
    ranked = with_ranks(rows, {"rank_one": "__one", "rank_two": "__two"})
    out = ranked.select(key, one, two, F.col("rank_one").cast("int").alias("rank_one"), F.col("rank_two").cast("int").alias("rank_two"))
    return out.withColumn("apart", F.abs(F.col("rank_one") - F.col("rank_two"))).withColumn("flag", F.col("apart") > beyond)


def profile(points: DataFrame, cluster: Column) -> DataFrame:
    """Party counts and position of each cluster, with a label by its majority; a tie counts as Democrat."""
    r, d = (count_where(F.col("party") == p) for p in PARTIES)
    out = points.withColumn("cluster", cluster).groupBy("cluster").agg(F.count("*").alias("n"), r.alias("r"), d.alias("d"), F.avg("xi").alias("mean"), F.median("xi").alias("median"), F.stddev_samp("xi").alias("std"))
    label = F.when(F.col("r") > F.col("d"), F.when(F.round("mean", 9) > 1, "Conservative R").otherwise("Moderate R")).otherwise("Democrat")
    return out.withColumn("label", label)


def coalitions(points: DataFrame, cluster: Column) -> DataFrame:
    """Names of clusters: a dominant party (over 80 %) with where it stands against its party's mean, else a bloc."""
    rows = points.withColumn("cluster", cluster)
    by = rows.groupBy("cluster", "party").agg(F.count("*").alias("n"))
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.round(F.median("xi"), 9).alias("median"))
    order = Window.partitionBy("cluster").orderBy(F.desc("n"), "party")
    top = by.withColumn("i", F.row_number().over(order)).where("i = 1").select("cluster", "party", "n")
    means = points.groupBy("party").agg(F.round(F.avg("xi"), 9).alias("party_mean"))
    out = top.join(sizes, "cluster").join(means, "party")
    away = F.col("median") - F.col("party_mean")
    word = F.when(F.abs(away) <= 0.3, "Mainstream").when((away > 0) & (F.col("party") == PARTIES[0]), "Conservative").when((away < 0) & (F.col("party") == PARTIES[1]), "Progressive").otherwise("Moderate")
    dominant = F.col("n") / F.col("size") > 0.8
    label = F.when(F.col("size") == 1, F.concat(F.lit("Solo "), F.col("party"))).when(dominant, F.concat(word, F.lit(" "), F.col("party"), F.lit("s"))).when(F.col("size") <= 5, "Cross-Party Bloc").otherwise("Bipartisan Coalition")
    return out.select("cluster", "party", "size", label.alias("label"))


def mavericks(unity: DataFrame, members: DataFrame) -> DataFrame:
    """The member of lowest unity of each chamber, the greater weighted maverick first; none where the lowest is over 0.95."""
    rows = unity.join(members.select("voter", "chamber"), "voter").withColumns({"u": F.round("unity", 9), "w": F.round("weighted_maverick", 9)})
    order = Window.partitionBy("chamber").orderBy("u", F.desc("w"), "voter")
    return rows.withColumn("i", F.row_number().over(order)).where("i = 1 and u <= 0.95").select("chamber", "voter", "party", "unity")


def bridge_builders(points: DataFrame, degrees: DataFrame) -> DataFrame:
    """Of the members within one deviation of the midpoint of the party medians, the one of the highest strength, by chamber."""
    one, two = PARTIES
    mid = points.groupBy("chamber").agg(F.median(F.when(F.col("party") == one, F.col("xi"))).alias("r"), F.median(F.when(F.col("party") == two, F.col("xi"))).alias("d"), F.stddev_samp("xi").alias("std"))
    rows = points.join(mid, "chamber").join(degrees, "voter")
    near = rows.where(F.round(F.abs(F.col("xi") - (F.col("r") + F.col("d")) / 2) - F.col("std"), 9) <= 0).withColumn("s", F.round("strength", 9))
    order = Window.partitionBy("chamber").orderBy(F.desc("s"), "voter")
    return near.withColumn("i", F.row_number().over(order)).where("i = 1").select("chamber", "voter", "party", "strength")


def metric_paradox(df: DataFrame, one: str, two: str, gap: float = 0.5, least: int = 5) -> DataFrame:
    """The majority party's member whose percentiles in two scores lie furthest apart, if at least ``gap``."""
    sizes = Window.partitionBy("party")
    rows = df.where(F.col(one).isNotNull() & F.col(two).isNotNull()).withColumn("size", F.count("*").over(sizes))
    main = rows.groupBy("party").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "party").limit(1).select("party")
    rows = rows.join(F.broadcast(main), "party").where(F.col("size") >= least)
    for k, c in (("p1", one), ("p2", two)):
        rows = rows.withColumn(k, F.row_number().over(Window.partitionBy("party").orderBy(c, "voter")) / F.col("size"))
    rows = rows.withColumn("gap", F.round(F.abs(F.col("p1") - F.col("p2")), 9))
    return rows.where(F.col("gap") >= gap).orderBy(F.desc("gap"), "voter").limit(1).select("voter", "party", "gap")


def quality(r: Column) -> Column:
    return F.when(r >= 0.90, "excellent").when(r >= 0.85, "good").when(r >= 0.70, "acceptable").when(r.isNotNull(), "poor")


def correlation_by(df: DataFrame, group: str, x: str, y: str, least: int = 3) -> DataFrame:
    """Pearson correlation inside of each group, with its Fisher interval and a quality label."""
    out = df.groupBy(group).agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), guarded_corr(x, y, least=least).alias("r"))
    z, half = F.atanh("r"), 1.959963984540054 / F.sqrt(F.col("n") - 3)
    inside = (F.abs("r") < 1 - 1e-9) & (F.col("n") > 3)
    return out.select(group, "n", "r", F.when(inside, F.tanh(z - half)).alias("low"), F.when(inside, F.tanh(z + half)).alias("high"), quality(F.round(F.abs("r"), 9)).alias("quality"))


def discriminating_items(encoded: DataFrame, classes: DataFrame, top: int = 30, least: int = 2) -> DataFrame:
    """Items whose Yea share differs most between classes (voter, cls)."""
    shares = encoded.join(classes, "voter").groupBy("item", "cls").agg(F.avg("y").alias("share"))
    out = shares.groupBy("item").agg(F.count("*").alias("classes"), F.round(F.max("share") - F.min("share"), 9).alias("spread")).where(F.col("classes") >= least)
    return out.orderBy(F.desc("spread"), "item").limit(top)


def temporal_holdout(encoded: DataFrame, items: DataFrame, share: float = 0.7) -> DataFrame:
    """Votes after the first ``share`` of items by date, predicted by the voter's Yea rate before."""
    days = items.groupBy("day").agg(F.count("*").alias("c"))
    upto = days.withColumn("upto", F.sum("c").over(Window.orderBy("day")))  # one row a day
    total = F.sum("c").over(Window.partitionBy())
    early = upto.withColumn("early", F.col("upto") <= F.floor(total * share)).select("day", "early")
    rows = encoded.join(items.select("item", "day"), "item").join(early, "day")
    rates = rows.where("early").groupBy("voter").agg(F.avg("y").alias("rate"))
    judged = rows.where("not early").join(rates, "voter")
    hit = ((F.col("rate") >= 0.5).cast("int") == F.col("y")).cast("int")
    return judged.agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.greatest(F.avg("y"), 1 - F.avg("y")).alias("baseline"))


def item_errors(scored: DataFrame, top: int = 20) -> DataFrame:
    """Items predicted worst: mean error over their votes."""
    out = scored.groupBy("item").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 9).alias("error"))
    return out.orderBy(F.desc("error"), "item").limit(top)


def error_classes(scored: DataFrame, *group: str) -> DataFrame:
    """Wrong predictions by kind: said Yea and wasn't, said Nay and wasn't."""
    said = F.round("p", 9) >= 0.5
    return scored.groupBy(*group).agg(count_where(said & (F.col("y") == 0)).alias("false_yea"), count_where(~said & (F.col("y") == 1)).alias("false_nay"), F.count("*").alias("n"))


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as z-scores; those of two values or fewer stay."""
    whole = df.agg(*(f(c).alias(f"__{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp), ("d", F.countDistinct))))  # one row
    rows = df.crossJoin(F.broadcast(whole))
    z = {c: F.when(F.col(f"__d_{c}") <= 2, F.col(c).cast("double")).otherwise(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}"))) for c in columns}
    return rows.withColumns(z).select(df.columns)


# ---------------------------------------------------------------- sessions


def cohorts(sessions: DataFrame) -> DataFrame:
    """Scores of those who stayed to the next session, who left after this one and who came with the next."""
    last = sessions.agg(F.min("session").alias("lo"), F.max("session").alias("hi"))
    here = sessions.alias("x").join(sessions.alias("z"), (F.col("x.person") == F.col("z.person")) & (F.col("z.session") == F.col("x.session") + 1), "left")
    own = here.select(F.col("x.session").alias("session"), F.when(F.col("z.person").isNull(), "left").otherwise("stayed").alias("cohort"), F.col("x.score").alias("score"))
    before = sessions.alias("z").join(sessions.alias("x"), (F.col("x.person") == F.col("z.person")) & (F.col("z.session") == F.col("x.session") + 1), "left_anti")
    came = before.select((F.col("session") - 1).alias("session"), F.lit("came").alias("cohort"), "score")
    rows = own.unionAll(came).crossJoin(F.broadcast(last)).where("session >= lo and session < hi")
    return rows.groupBy("session", "cohort").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))


def bloc_switches(sessions: DataFrame, blocs: int = 4) -> DataFrame:
    """How many persons go from which quantile bloc of a session to which of the next."""
    place = F.ntile(blocs).over(Window.partitionBy("session").orderBy("score", "person"))
    rows = sessions.select("person", "session", place.alias("bloc"))
    after = rows.select("person", (F.col("session") - 1).alias("session"), F.col("bloc").alias("to"))
    return rows.join(after, ["person", "session"]).groupBy("session", F.col("bloc").alias("from"), "to").agg(F.count("*").alias("n"))


def stacked(sessions: DataFrame) -> DataFrame:
    """Sessions in one table with person and time numbers counted from 0."""
    times = sessions.select("session").distinct()
    times = times.select("session", (F.row_number().over(Window.orderBy("session")) - 1).alias("time"))  # one row a session
    return sessions.join(F.broadcast(times), "session")


def bridge_matrix(sessions: DataFrame) -> DataFrame:
    """Persons that two sessions share."""
    keys = sessions.select("person", "session").distinct()
    return keys.alias("x").join(keys.alias("z"), (F.col("x.person") == F.col("z.person")) & (F.col("x.session") < F.col("z.session"))).groupBy(F.col("x.session").alias("one"), F.col("z.session").alias("two")).agg(F.count("*").alias("shared"))


def trajectory(rows: DataFrame) -> DataFrame:
    """Means of the two parties, their gap and effect size by session of (session, party, score); a session passes if d >= 1.5."""
    one, two = PARTIES

    def side(p: str, f):
        return f(F.when(F.col("party") == p, F.col("score")))

    out = rows.groupBy("session").agg(*(side(p, f).alias(f"{k}{i}") for i, p in enumerate((one, two), 1) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), F.col("n1") + F.col("n2") - 2))
    d = F.try_divide(F.col("m1") - F.col("m2"), pooled)
    return out.select("session", "n1", "n2", F.col("m1").alias("mean1"), F.col("m2").alias("mean2"), (F.col("m1") - F.col("m2")).alias("gap"), d.alias("d"), F.coalesce((F.round(d, 9) >= 1.5) & (F.col("m1") > F.col("m2")), F.lit(False)).alias("passes"))


def drift_label(psi: Column) -> Column:
    """Bounds and labels of a population stability index."""
    return F.when(psi.isNull(), "insufficient data").when(psi < 0.10, "stable").when(psi <= 0.25, "investigate").otherwise("significant drift")


def latest(sessions: DataFrame, least: int = 2) -> DataFrame:
    """The latest session of each person that has ``least`` of them."""
    return sessions.groupBy("person").agg(F.count("*").alias("sessions"), F.max("session").alias("session"), F.max_by("score", "session").alias("score")).where(F.col("sessions") >= least)
