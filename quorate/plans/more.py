"""Queries on members, clusters, sessions and records from outside, registered in the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agreement, align, checks, cohesion, graph, lifecycle, networks, records, synthesis
from . import catalog
from .adapter import with_views
from .catalog import COO, COUNTS, FEATURES, GRAPH, KAPPA, PAIRS, RICED, UNITY, VM, Tables, on, register

# ---------------------------------------------------------------- members

POS = COO + """,
rates AS (SELECT voter, avg(y) AS rate, count(*) AS n FROM coo GROUP BY voter),
pos AS (SELECT voter, n, round((rate - avg(rate) OVER ()) / stddev_samp(rate) OVER (), 9) AS xi, full_name, party, chamber, district FROM rates JOIN members USING (voter))"""
POS_AFTER = POS[POS.index("rates AS") :]
#: A cluster of the test members: their chamber and on which side of zero they stand.
CLUSTER = "chamber || CASE WHEN xi > 0 THEN ' above' ELSE ' below' END"


def _points(t: Tables) -> DataFrame:
    return synthesis.positions(agreement.encode(t.votes), t.members)


def _cluster():
    return F.concat(F.col("chamber"), F.when(F.col("xi") > 0, " above").otherwise(" below"))


def _unity(t: Tables) -> DataFrame:
    return cohesion.unity(t.votes, t.members)


def _both(t: Tables) -> DataFrame:
    return _points(t).join(_unity(t).select("voter", F.round("unity", 9).alias("unity")), "voter")


BOTH = UNITY + ", " + POS + ", both_ AS (SELECT pos.*, round(unity, 9) AS unity FROM pos JOIN united USING (voter))"

register("member_positions", on(_points, "xi"), with_views(*VM, more=POS) + "SELECT voter, n, round(xi, 6) AS xi, full_name, party, chamber, district FROM pos")
register("horseshoe_check", on(lambda t: synthesis.horseshoe(_points(t)), "d_above", "overlap"), with_views(*VM, more=POS) + """
, s AS (SELECT chamber, min(xi) FILTER (WHERE party = 'Republican') AS lo, max(xi) FILTER (WHERE party = 'Democrat') AS hi, round(avg(xi) FILTER (WHERE party = 'Democrat'), 9) AS dm FROM pos GROUP BY 1),
o AS (SELECT chamber, lo, dm, avg(CASE WHEN party = 'Democrat' THEN CASE WHEN xi > 0 THEN 1 ELSE 0 END END) AS da, avg(CASE WHEN party = 'Republican' THEN CAST(xi <= hi AS INTEGER) WHEN party = 'Democrat' THEN CAST(xi >= lo AS INTEGER) END) AS ov FROM pos JOIN s USING (chamber) GROUP BY 1, 2, 3)
SELECT chamber, round(da, 6) AS d_above, round(ov, 6) AS overlap, coalesce(round(da, 9) > 0.2 OR lo < dm OR round(ov, 9) > 0.3, false) AS detected FROM o""")
register("supermajority", on(lambda t: synthesis.supermajority(t.members), "share"), with_views("members") + """
, s AS (SELECT chamber, party, count(*) AS seats, CAST(sum(count(*)) OVER (PARTITION BY chamber) AS BIGINT) AS total FROM members GROUP BY 1, 2)
SELECT chamber, party, seats, total, round(seats / CAST(total AS DOUBLE), 6) AS share, round(seats / CAST(total AS DOUBLE), 9) >= 0.7 AS supermajority FROM s""")
register("cross_party_agreement", on(lambda t: synthesis.cross_party_agreement(agreement.encode(t.votes), t.members), "agreement"), with_views(*VM, more=COO) + """
, p AS (SELECT item, party, round(avg(y), 9) AS share, count(*) AS voters FROM coo JOIN members USING (voter) GROUP BY 1, 2), o AS (SELECT * FROM p WHERE voters >= 3 AND share BETWEEN 0.1 AND 0.9),
b AS (SELECT r.item, r.share AS r, d.share AS d FROM o r JOIN o d ON r.item = d.item AND r.party = 'Republican' AND d.party = 'Democrat')
SELECT voter, party, count(*) AS n, round(avg(CASE WHEN y = CASE WHEN CASE party WHEN 'Republican' THEN d ELSE r END >= 0.5 THEN 1 ELSE 0 END THEN 1 ELSE 0 END), 6) AS agreement FROM coo JOIN members USING (voter) JOIN b USING (item) GROUP BY 1, 2 HAVING count(*) >= 5""")
register("rank_comparison", on(lambda t: synthesis.rank_comparison(_both(t), "voter", "xi", "unity"), "xi", "unity"), with_views(*VM, more=BOTH) + """
, r AS (SELECT voter, xi, unity, CAST(floor(rank() OVER (ORDER BY xi DESC) + (count(*) OVER (PARTITION BY xi) - 1) / 2.0) AS INTEGER) AS rank_one, CAST(floor(rank() OVER (ORDER BY unity DESC) + (count(*) OVER (PARTITION BY unity) - 1) / 2.0) AS INTEGER) AS rank_two FROM both_)
SELECT voter, round(xi, 6) AS xi, round(unity, 6) AS unity, rank_one, rank_two, abs(rank_one - rank_two) AS apart, abs(rank_one - rank_two) > 10 AS flag FROM r""")
register("cluster_profiles", on(lambda t: synthesis.profile(_points(t), _cluster()), "mean", "median", "std"), with_views(*VM, more=POS) + f"""
, c AS (SELECT {CLUSTER} AS cluster, count(*) AS n, count(*) FILTER (WHERE party = 'Republican') AS r, count(*) FILTER (WHERE party = 'Democrat') AS d, avg(xi) AS mean, median(xi) AS median, stddev_samp(xi) AS std FROM pos GROUP BY 1)
SELECT cluster, n, r, d, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, CASE WHEN r > d THEN CASE WHEN round(mean, 9) > 1 THEN 'Conservative R' ELSE 'Moderate R' END ELSE 'Democrat' END AS label FROM c""")
register("coalition_labels", on(lambda t: synthesis.coalitions(_points(t), _cluster())), with_views(*VM, more=POS) + f"""
, c AS (SELECT *, {CLUSTER} AS cluster FROM pos), s AS (SELECT cluster, count(*) AS size, round(median(xi), 9) AS med FROM c GROUP BY 1), m AS (SELECT party, round(avg(xi), 9) AS pm FROM pos GROUP BY 1),
p AS (SELECT cluster, party, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, party) AS i FROM c GROUP BY 1, 2), x AS (SELECT cluster, party, n, size, med - pm AS away FROM p JOIN s USING (cluster) JOIN m USING (party) WHERE i = 1)
SELECT cluster, party, size, CASE WHEN size = 1 THEN 'Solo ' || party WHEN n / CAST(size AS DOUBLE) > 0.8 THEN CASE WHEN abs(away) <= 0.3 THEN 'Mainstream' WHEN away > 0 AND party = 'Republican' THEN 'Conservative' WHEN away < 0 AND party = 'Democrat' THEN 'Progressive' ELSE 'Moderate' END || ' ' || party || 's'
WHEN size <= 5 THEN 'Cross-Party Bloc' ELSE 'Bipartisan Coalition' END AS label FROM x""")
register("chamber_mavericks", on(lambda t: synthesis.mavericks(_unity(t), t.members), "unity"), with_views(*VM, more=UNITY) + """
, r AS (SELECT chamber, voter, u.party, unity, row_number() OVER (PARTITION BY chamber ORDER BY round(unity, 9), round(weighted_maverick, 9) DESC, voter) AS i FROM united u JOIN members USING (voter))
SELECT chamber, voter, party, round(unity, 6) AS unity FROM r WHERE i = 1 AND round(unity, 9) <= 0.95""")
register("bridge_builders", on(lambda t: synthesis.bridge_builders(_points(t), graph.degrees(catalog._graph(t))), "strength"), with_views(*VM, more=GRAPH + ", " + POS_AFTER) + """
, m AS (SELECT chamber, (median(xi) FILTER (WHERE party = 'Republican') + median(xi) FILTER (WHERE party = 'Democrat')) / 2 AS mid, stddev_samp(xi) AS std FROM pos GROUP BY 1),
r AS (SELECT chamber, voter, party, strength, row_number() OVER (PARTITION BY chamber ORDER BY round(strength, 9) DESC, voter) AS i FROM pos JOIN m USING (chamber) JOIN degrees USING (voter) WHERE round(abs(xi - mid) - std, 9) <= 0)
SELECT chamber, voter, party, round(strength, 6) AS strength FROM r WHERE i = 1""")
register("metric_paradox", on(lambda t: synthesis.metric_paradox(_both(t), "xi", "unity"), "gap"), with_views(*VM, more=BOTH) + """
, m AS (SELECT party FROM both_ GROUP BY 1 ORDER BY count(*) DESC, party LIMIT 1), p AS (SELECT voter, party, count(*) OVER () AS size, row_number() OVER (ORDER BY xi, voter) AS a, row_number() OVER (ORDER BY unity, voter) AS b FROM both_ WHERE party = (SELECT party FROM m)),
g AS (SELECT voter, party, round(abs(a / CAST(size AS DOUBLE) - b / CAST(size AS DOUBLE)), 9) AS gap FROM p WHERE size >= 5)
SELECT voter, party, round(gap, 6) AS gap FROM g WHERE gap >= 0.5 ORDER BY g.gap DESC, voter LIMIT 1""")
register("within_party_correlation", on(lambda t: synthesis.correlation_by(_both(t), "party", "xi", "unity"), "r", "low", "high"), with_views(*VM, more=BOTH) + """
, c AS (SELECT party, count(*) AS n, avg(xi * unity) - avg(xi) * avg(unity) AS cov, avg(xi * xi) - avg(xi) * avg(xi) AS va, avg(unity * unity) - avg(unity) * avg(unity) AS vb FROM both_ GROUP BY party),
r AS (SELECT party, n, CASE WHEN n >= 3 AND va > 1e-12 AND vb > 1e-12 THEN cov / sqrt(va * vb) END AS r FROM c)
SELECT party, n, round(r, 6) AS r, round(CASE WHEN abs(r) < 1 - 1e-9 AND n > 3 THEN tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)) END, 6) AS low, round(CASE WHEN abs(r) < 1 - 1e-9 AND n > 3 THEN tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)) END, 6) AS high,
CASE WHEN round(abs(r), 9) >= 0.9 THEN 'excellent' WHEN round(abs(r), 9) >= 0.85 THEN 'good' WHEN round(abs(r), 9) >= 0.7 THEN 'acceptable' WHEN r IS NOT NULL THEN 'poor' END AS quality FROM r""")
register("discriminating_items", on(lambda t: synthesis.discriminating_items(agreement.encode(t.votes), t.members.select("voter", F.concat_ws(" ", "party", "chamber").alias("cls"))), "spread"), with_views(*VM, more=COO) + """
, s AS (SELECT item, party || ' ' || chamber AS cls, avg(y) AS share FROM coo JOIN members USING (voter) GROUP BY 1, 2), o AS (SELECT item, count(*) AS classes, round(max(share) - min(share), 9) AS spread FROM s GROUP BY 1 HAVING count(*) >= 2 ORDER BY spread DESC, item LIMIT 30)
SELECT item, classes, round(spread, 6) AS spread FROM o""")
register("temporal_holdout", on(lambda t: synthesis.temporal_holdout(agreement.encode(t.votes), t.items), "accuracy", "baseline"), with_views("items", "votes", more=COO) + """
, d AS (SELECT day, sum(count(*)) OVER (ORDER BY day) AS upto, sum(count(*)) OVER () AS total FROM items GROUP BY day), e AS (SELECT day, upto <= floor(total * 0.7) AS early FROM d), r AS (SELECT voter, y, early FROM coo JOIN items USING (item) JOIN e USING (day)),
t AS (SELECT voter, avg(y) AS rate FROM r WHERE early GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN (rate >= 0.5) = (y = 1) THEN 1 ELSE 0 END), 6) AS accuracy, round(greatest(avg(y), 1 - avg(y)), 6) AS baseline FROM r JOIN t USING (voter) WHERE NOT early""")
register("surprising_items", on(lambda t: synthesis.item_errors(catalog._scored(t)), "error"), with_views(*VM, more=FEATURES) + """
, e AS (SELECT item, count(*) AS n, round(avg(abs(p - y)), 9) AS error FROM scored GROUP BY 1 ORDER BY error DESC, item LIMIT 20) SELECT item, n, round(error, 6) AS error FROM e""")
register("error_classes", on(lambda t: synthesis.error_classes(catalog._scored(t), "party")), with_views(*VM, more=FEATURES) + """
SELECT party, count(*) FILTER (WHERE round(p, 9) >= 0.5 AND y = 0) AS false_yea, count(*) FILTER (WHERE round(p, 9) < 0.5 AND y = 1) AS false_nay, count(*) AS n FROM scored GROUP BY party""")
register("standardised_members", on(lambda t: synthesis.standardised(_both(t).select("voter", "n", "xi", "unity"), ["n", "unity"]), "n", "xi", "unity"), with_views(*VM, more=BOTH) + """
SELECT voter, round((n - avg(n) OVER ()) / nullif(stddev_samp(n) OVER (), 0), 6) AS n, round(xi, 6) AS xi, round((unity - avg(unity) OVER ()) / nullif(stddev_samp(unity) OVER (), 0), 6) AS unity FROM both_
WHERE (SELECT count(DISTINCT n) > 2 AND count(DISTINCT unity) > 2 FROM both_)""")
register("override_cohesion", on(lambda t: _riced_on(t, "brand#1"), "mean"), with_views("items", *VM, more=RICED) + """
SELECT party, count(*) AS n, round(avg(rice), 6) AS mean FROM riced JOIN items USING (item) WHERE rice IS NOT NULL AND contains(lower(motion), 'brand#1') GROUP BY party HAVING count(*) >= 2""")
register("cluster_motion_rates", on(lambda t: _cluster_rates(t, "brand#1"), "rate"), with_views("items", *VM, more=POS) + f"""
SELECT {CLUSTER} AS cluster, count(*) AS n, round(avg(y), 6) AS rate FROM coo JOIN pos USING (voter) JOIN items i USING (item) WHERE contains(lower(motion), 'brand#1') GROUP BY 1""".replace("chamber ||", "pos.chamber ||"))


def _riced_on(t: Tables, word: str) -> DataFrame:
    rows = catalog._riced(t).join(t.items.where(F.lower("motion").contains(word)).select("item"), "item").where("rice is not null")
    return rows.groupBy("party").agg(F.count("*").alias("n"), F.avg("rice").alias("mean")).where("n >= 2")


def _cluster_rates(t: Tables, word: str) -> DataFrame:
    rows = agreement.encode(t.votes).join(t.items.where(F.lower("motion").contains(word)).select("item"), "item").join(_points(t).select("voter", "chamber", "xi"), "voter")
    return rows.groupBy(_cluster().alias("cluster")).agg(F.count("*").alias("n"), F.avg("y").alias("rate"))


# ---------------------------------------------------------------- networks

SUBSET = PAIRS.replace("FROM votes WHERE", "FROM votes JOIN items USING (item) WHERE contains(lower(motion), 'brand#1') AND").replace(">= 10", ">= 5")
register("kappa_distances", on(lambda t: networks.distances(catalog._pairs(t)), "distance"), with_views("votes", more=PAIRS) + "SELECT a, b, round(greatest(coalesce(1 - kappa, max(1 - kappa) OVER ()), 0.0), 6) AS distance FROM pairs")
register("subset_edges", on(lambda t: graph.edges(agreement.pairs(agreement.encode(t.votes.join(t.items.where(F.lower("motion").contains("brand#1")).select("item"), "item")), 5), KAPPA), "weight"), with_views("items", "votes", more=SUBSET) + f"SELECT a, b, round(kappa, 6) AS weight FROM pairs WHERE kappa > {KAPPA}")
register("party_centrality", on(lambda t: networks.centrality_by(graph.degrees(catalog._graph(t)), t.members, "party"), *(f"{k}_{c}" for k in ("mean", "median", "std") for c in ("degree", "strength"))), with_views(*VM, more=GRAPH) + """
SELECT party, count(*) AS n, round(avg(degree), 6) AS mean_degree, round(median(degree), 6) AS median_degree, round(stddev_samp(degree), 6) AS std_degree, round(avg(strength), 6) AS mean_strength, round(median(strength), 6) AS median_strength, round(stddev_samp(strength), 6) AS std_strength
FROM degrees JOIN members USING (voter) GROUP BY party""")
ENDS = " FROM edges JOIN members x ON x.voter = a JOIN members z ON z.voter = b "
register("within_party_edges", on(lambda t: networks.between(catalog._graph(t), t.members, "party", True), "weight"), with_views(*VM, more=GRAPH) + "SELECT a, b, x.party AS one, z.party AS two, round(weight, 6) AS weight" + ENDS + "WHERE x.party = z.party")
register("cross_chamber_edges", on(lambda t: networks.between(catalog._graph(t), t.members, "chamber", False), "weight"), with_views(*VM, more=GRAPH) + "SELECT a, b, least(x.chamber, z.chamber) AS one, greatest(x.chamber, z.chamber) AS two, round(weight, 6) AS weight" + ENDS + "WHERE x.chamber <> z.chamber")
register("extreme_ties", on(lambda t: networks.extreme_weights(catalog._graph(t), _points(t)), "mean", "median", "least", "party_median"), with_views(*VM, more=GRAPH + ", " + POS_AFTER) + """
, m AS (SELECT party FROM pos GROUP BY 1 ORDER BY count(*) DESC, party LIMIT 1), own AS (SELECT * FROM pos WHERE party = (SELECT party FROM m)), far AS (SELECT voter FROM own ORDER BY abs(xi) DESC, voter LIMIT 2),
i AS (SELECT a, b, weight FROM edges WHERE a IN (SELECT voter FROM own) AND b IN (SELECT voter FROM own)), e AS (SELECT a AS voter, weight FROM i UNION ALL SELECT b, weight FROM i)
SELECT voter, count(*) AS ties, round(avg(weight), 6) AS mean, round(median(weight), 6) AS median, round(min(weight), 6) AS least, round((SELECT median(weight) FROM i), 6) AS party_median FROM e WHERE voter IN (SELECT voter FROM far) GROUP BY voter""")
register("two_sided_summary", on(lambda t: networks.two_sided(t.votes), "density", "mean_voter_degree", "mean_item_degree"), with_views("votes") + """
, s AS (SELECT count(*) AS edges, count(DISTINCT voter) AS voters, count(DISTINCT item) AS items FROM votes WHERE choice = 'Yea')
SELECT *, round(edges / CAST(voters * items AS DOUBLE), 6) AS density, round(edges / CAST(voters AS DOUBLE), 6) AS mean_voter_degree, round(edges / CAST(items AS DOUBLE), 6) AS mean_item_degree FROM s""")
register("motion_profiles", on(lambda t: networks.item_groups(cohesion.item_polarization(t.votes, t.members), t.items, F.col("motion")), "r_share", "d_share", "polarization"), with_views("items", *VM, more=COUNTS) + """
, s AS (SELECT item, max(yea / CAST(voters AS DOUBLE)) FILTER (WHERE party = 'Republican') AS r, max(yea / CAST(voters AS DOUBLE)) FILTER (WHERE party = 'Democrat') AS d FROM counts GROUP BY item HAVING sum(voters) >= 10)
SELECT motion AS kind, count(*) AS n, round(avg(r), 6) AS r_share, round(avg(d), 6) AS d_share, round(avg(abs(r - d)), 6) AS polarization FROM s JOIN items USING (item) WHERE r IS NOT NULL AND d IS NOT NULL GROUP BY 1""")
register("community_composition", on(lambda t: networks.composition(_points(t), F.col("district")), "mean", "least", "most"), with_views(*VM, more=POS) + """
SELECT district AS community, count(*) AS n, count(*) FILTER (WHERE party = 'Republican') AS r, count(*) FILTER (WHERE party = 'Democrat') AS d, round(avg(xi), 6) AS mean, round(min(xi), 6) AS least, round(max(xi), 6) AS most FROM pos GROUP BY 1""")

# ---------------------------------------------------------------- matrices of choices

CATEGORIES = "cats AS (SELECT voter, item, CASE WHEN choice LIKE 'Absent%' THEN 'Absent' ELSE choice END AS cat FROM votes)"


def _categories(t: Tables) -> DataFrame:
    rows = t.votes.select("voter", "item", F.when(F.col("choice").startswith("Absent"), "Absent").otherwise(F.col("choice")).alias("cat"))
    shares = rows.groupBy("item").agg(F.round(F.avg((F.col("cat") == "Yea").cast("int")), 9).alias("share"))
    kept = rows.join(shares.where(F.least("share", 1 - F.col("share")) >= 0.1).select("item"), "item")
    enough = kept.where("cat <> 'Absent'").groupBy("voter").agg(F.count("*").alias("n")).where("n >= 10").select("voter")
    return kept.join(enough, "voter", "left_semi").select("voter", "item", "cat")


def _missing(t: Tables) -> DataFrame:
    held = agreement.encode(t.votes).groupBy("voter").agg(F.count("*").alias("known"))
    total = t.votes.agg(F.countDistinct("item").alias("items"))
    return held.crossJoin(F.broadcast(total)).select("voter", F.round(100 * (1 - F.col("known") / F.col("items")), 1).alias("missing"))


register("categorical_votes", on(_categories), with_views("votes", more=CATEGORIES) + """
, s AS (SELECT item FROM cats GROUP BY 1 HAVING least(round(avg(CASE WHEN cat = 'Yea' THEN 1 ELSE 0 END), 9), 1 - round(avg(CASE WHEN cat = 'Yea' THEN 1 ELSE 0 END), 9)) >= 0.1), k AS (SELECT * FROM cats WHERE item IN (SELECT item FROM s)),
e AS (SELECT voter FROM k WHERE cat <> 'Absent' GROUP BY 1 HAVING count(*) >= 10) SELECT voter, item, cat FROM k WHERE voter IN (SELECT voter FROM e)""")
register("imputation_share", on(_missing), with_views("votes", more=COO) + "SELECT voter, round(100 * (1 - count(*) / CAST((SELECT count(DISTINCT item) FROM votes) AS DOUBLE)), 1) AS missing FROM coo GROUP BY voter")

# ---------------------------------------------------------------- sessions

register("turnover_cohorts", on(lambda t: synthesis.cohorts(t.sessions), "mean", "std"), with_views("sessions") + """
, l AS (SELECT min(session) AS lo, max(session) AS hi FROM sessions), r AS (SELECT x.session, CASE WHEN z.person IS NULL THEN 'left' ELSE 'stayed' END AS cohort, x.score FROM sessions x LEFT JOIN sessions z ON x.person = z.person AND z.session = x.session + 1
    UNION ALL SELECT z.session - 1, 'came', z.score FROM sessions z WHERE NOT EXISTS (SELECT 1 FROM sessions x WHERE x.person = z.person AND x.session = z.session - 1))
SELECT session, cohort, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std FROM r, l WHERE session >= lo AND session < hi GROUP BY 1, 2""")
register("bloc_switches", on(lambda t: synthesis.bloc_switches(t.sessions.withColumn("score", F.round("score", 6)))), with_views("sessions") + """
, b AS (SELECT person, session, CAST(ntile(4) OVER (PARTITION BY session ORDER BY round(score, 6), person) AS INTEGER) AS bloc FROM sessions) SELECT x.session, x.bloc AS "from", z.bloc AS "to", count(*) AS n FROM b x JOIN b z ON x.person = z.person AND z.session = x.session + 1 GROUP BY 1, 2, 3""")
register("stacked_sessions", on(lambda t: synthesis.stacked(t.sessions), "score"), with_views("sessions") + "SELECT person, session, round(score, 6) AS score, CAST(dense_rank() OVER (ORDER BY session) - 1 AS INTEGER) AS time FROM sessions")
register("bridge_matrix", on(lambda t: synthesis.bridge_matrix(t.sessions)), with_views("sessions") + "SELECT x.session AS one, z.session AS two, count(*) AS shared FROM sessions x JOIN sessions z ON x.person = z.person AND x.session < z.session GROUP BY 1, 2")
register("latest_sessions", on(lambda t: synthesis.latest(t.sessions), "score"), with_views("sessions") + "SELECT person, count(*) AS sessions, max(session) AS session, round(max_by(score, session), 6) AS score FROM sessions GROUP BY 1 HAVING count(*) >= 2")
register("polarization_trajectory", on(lambda t: synthesis.trajectory(t.sessions.select("session", F.when(F.col("person") % 2 == 0, "Republican").otherwise("Democrat").alias("party"), "score")), "mean1", "mean2", "gap", "d"), with_views("sessions") + """
, s AS (SELECT session, count(*) FILTER (WHERE person % 2 = 0) AS n1, count(*) FILTER (WHERE person % 2 <> 0) AS n2, avg(score) FILTER (WHERE person % 2 = 0) AS m1, avg(score) FILTER (WHERE person % 2 <> 0) AS m2, var_samp(score) FILTER (WHERE person % 2 = 0) AS v1, var_samp(score) FILTER (WHERE person % 2 <> 0) AS v2 FROM sessions GROUP BY 1),
e AS (SELECT *, (m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 0) AS d FROM s)
SELECT session, n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2, round(m1 - m2, 6) AS gap, round(d, 6) AS d, coalesce(round(d, 9) >= 1.5 AND m1 > m2, false) AS passes FROM e""")
register("drift_labels", on(lambda t: align.population_shift(t.sessions).select("session", synthesis.drift_label(F.round("psi", 9)).alias("label"))), catalog.ORACLES["population_shift"].replace("SELECT session, round(sum((pa - pe) * ln(pa / pe)), 6) AS psi FROM p GROUP BY session", """
SELECT session, CASE WHEN x IS NULL THEN 'insufficient data' WHEN x < 0.10 THEN 'stable' WHEN x <= 0.25 THEN 'investigate' ELSE 'significant drift' END AS label FROM (SELECT session, round(sum((pa - pe) * ln(pa / pe)), 9) AS x FROM p GROUP BY session)"""))

# ---------------------------------------------------------------- records from outside

#: Texts that each path of the classifiers meets, dealt to events by their number.
MOTIONS = ["Emergency Final Action - passed", "final action; Passed", "Committee of the Whole - be adopted", "Consent Calendar", "Motion to override the veto", "Conference Committee report adopted", "Motion to concur prevailed", "Veto sustained", "Not passed", "Amendment rejected", "Referred", "Bypassed"]
STATUSES = ["Introduced", "Referred to Committee on Taxes", "Scheduled for hearing", "Committee report recommending passage", "Committee of the Whole", "Emergency final action", "Received by the other chamber", "Approved by Governor", "Vetoed by Governor", "Enrolled and presented", "Withdrawn"]


def _dealt(texts: list[str], key: str):
    return F.element_at(F.array(*map(F.lit, texts)), (F.col(key) % len(texts) + 1).cast("int"))


def _dealt_sql(texts: list[str], key: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in texts) + f"][CAST({key} % {len(texts)} + 1 AS INTEGER)]"


register("motion_kinds", on(lambda t: t.events.select(_dealt(MOTIONS, "event_id").alias("motion")).withColumns({"kind": records.motion_kind(F.col("motion")), "passed": lifecycle.outcome(F.col("motion"))}).groupBy("motion", "kind", "passed").agg(F.count("*").alias("n"))), f"""
WITH e AS (SELECT {_dealt_sql(MOTIONS, "event_id")} AS motion FROM events), k AS (SELECT motion, lower(trim(motion)) AS m FROM e)
SELECT motion, CASE WHEN m LIKE 'emergency final action%' THEN 'Emergency Final Action' WHEN m LIKE 'final action%' THEN 'Final Action' WHEN m LIKE 'committee of the whole%' THEN 'Committee of the Whole' WHEN m LIKE 'consent calendar%' THEN 'Consent Calendar'
WHEN m LIKE '%override%' AND m LIKE '%veto%' THEN 'Veto Override' WHEN m LIKE '%conference committee%' THEN 'Conference Committee' WHEN m LIKE '%concur%' THEN 'Concurrence' ELSE '' END AS kind,
CASE WHEN regexp_matches(m, '\\b(not\\s+passed|failed|rejected)\\b') OR m LIKE '%sustained%' THEN false WHEN regexp_matches(m, '\\b(passed|adopted|prevailed|concurred)\\b') THEN true END AS passed, count(*) AS n FROM k GROUP BY 1, 2, 3""")
STAGED = f"""WITH a AS (SELECT user_id AS bill, ts, event_id, lower({_dealt_sql(STATUSES, "event_id")}) AS s FROM events),
st AS (SELECT *, CASE WHEN s LIKE '%introduced%' THEN 'Introduced' WHEN s LIKE '%referred to committee%' THEN 'Committee Referral' WHEN s LIKE '%hearing%' THEN 'Hearing' WHEN s LIKE '%committee report recommending%' THEN 'Committee Report'
    WHEN s LIKE '%committee of the whole%' THEN 'Committee of the Whole' WHEN s LIKE '%final action%' OR s LIKE '%roll call%' THEN 'Floor Vote' WHEN s LIKE '%received by%' OR s LIKE '%transmitted to%' THEN 'Cross-Chamber' WHEN s LIKE '%approved by governor%' THEN 'Signed into Law'
    WHEN s LIKE '%vetoed by governor%' OR s LIKE '%line item veto%' THEN 'Vetoed' WHEN s LIKE '%enrolled and presented%' THEN 'Governor' ELSE 'Other' END AS stage FROM a)"""
register("legislative_stages", on(lambda t: lifecycle.stage_counts(_actions(t))), STAGED + " SELECT stage, count(*) AS n, count(DISTINCT bill) AS bills FROM st GROUP BY stage")
register("legislative_transitions", on(lambda t: lifecycle.transitions(_actions(t))), STAGED + """
, l AS (SELECT *, lag(stage) OVER (PARTITION BY bill ORDER BY ts, event_id) AS before FROM st), s AS (SELECT bill, ts, event_id, stage FROM l WHERE before IS NULL OR before <> stage), t AS (SELECT stage AS source, lead(stage) OVER (PARTITION BY bill ORDER BY ts, event_id) AS target FROM s)
SELECT source, coalesce(target, 'Died') AS target, count(*) AS n FROM t WHERE target IS NOT NULL OR source NOT IN ('Floor Vote', 'Cross-Chamber', 'Governor', 'Signed into Law', 'Vetoed') GROUP BY 1, 2""")


def _actions(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("bill"), "ts", "event_id", _dealt(STATUSES, "event_id").alias("status"))


register("bill_order", on(lambda t: t.part.select("p_partkey", records.bill_of_url(F.concat(F.lit("/li/b2025/Measures/"), _dealt(["sb", "hb", "scr", "xx"], "p_partkey"), F.col("p_partkey").cast("string"), F.lit("/"))).alias("bill")).withColumns(dict(zip(("prefix_order", "number"), records.bill_key(F.col("bill")), strict=True)))), f"""
WITH b AS (SELECT p_partkey, {_dealt_sql(["SB", "HB", "SCR", "XX"], "p_partkey")} AS p FROM part) SELECT p_partkey, p || ' ' || CAST(p_partkey AS VARCHAR) AS bill, CASE p WHEN 'SB' THEN 0 WHEN 'HB' THEN 3 WHEN 'SCR' THEN 2 ELSE 9 END AS prefix_order, CAST(p_partkey AS INTEGER) AS number FROM b""")
#: A page as PDF readers give it, put in front of every document.
PAGE = "  1  sec-\ntion\n 117 \n\n\n\n 2 of\ufb01ce\n2024 was a year\n100 dollars\n43 "
register("clean_texts", on(lambda t: t.documents.select("doc_id", F.sha2(records.clean_text(records.strip_line_numbers(F.concat(F.lit(PAGE), F.coalesce("text", F.lit(""))))), 256).alias("sha256"))), f"""
WITH d AS (SELECT doc_id, regexp_replace('{PAGE}' || coalesce(text, ''), '(?m)^[ \\t]{{0,4}}[0-9]{{1,2}}[ \\t]{{1,4}}', '', 'g') AS t FROM documents),
p AS (SELECT doc_id, regexp_replace(replace(replace(replace(replace(t, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '(?m)^[ \\t]*[0-9]{{1,3}}[ \\t]*$', '', 'g') AS t FROM d)
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(t, '([A-Za-z0-9_])-\\n([A-Za-z0-9_])', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), '\\n\\n\\n+', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))) AS sha256 FROM p""")
register("content_hashes", on(lambda t: t.documents.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))), "SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
TITLES = ["Senator ", "representative  ", "Committee on ", ""]
register("sponsor_parties", on(lambda t: records.sponsor_party(t.members.select(F.concat(_dealt(TITLES, "district"), F.col("full_name")).alias("raw")), t.members)), with_views("members") + f"""
, s AS (SELECT {_dealt_sql(TITLES, "district")} || full_name AS raw, district % 4 AS k, full_name FROM members), n AS (SELECT raw, CASE WHEN k < 2 THEN full_name END AS name, CASE k WHEN 0 THEN 'Senate' WHEN 1 THEN 'House' END AS chamber FROM s),
f AS (SELECT lower(full_name) AS l, chamber AS c, min(voter) AS voter, min_by(party, voter) AS party FROM members GROUP BY 1, 2) SELECT raw, name, chamber, voter, party FROM n LEFT JOIN f ON lower(name) = l AND chamber = c""")
register("sponsorship", on(lambda t: records.sponsorship(t.items.select("bill", "motion", F.concat_ws("; ", "motion", "chamber", F.lit("")).alias("sponsors")))), with_views("items") + """
, e AS (SELECT DISTINCT bill, motion AS name, 0 AS place FROM items UNION ALL SELECT DISTINCT bill, chamber, 1 FROM items) SELECT name, count(DISTINCT bill) AS bills, count(DISTINCT CASE WHEN place = 0 THEN bill END) AS primary FROM e WHERE trim(name) <> '' GROUP BY name""")
register("tidy_members", on(lambda t: records.tidy_members(t.members.select("voter", F.concat("full_name", F.lit(" - Majority Leader")).alias("full_name"), F.when(F.col("district") % 3 == 0, "  ").otherwise(F.col("party")).alias("party")))), with_views("members") + """
SELECT voter, full_name, CASE WHEN district % 3 = 0 THEN 'Independent' ELSE party END AS party FROM members""")
register("member_slugs", on(lambda t: t.members.select("voter", records.slug(F.concat(F.lit("Ann "), F.translate("full_name", "#0123456789", "#abcdefghij"), F.lit(" Jr.")), F.col("chamber")).alias("slug"))), with_views("members") + """
SELECT voter, CASE WHEN chamber = 'Senate' THEN 'sen_' ELSE 'rep_' END || replace(translate(lower(full_name), '0123456789', 'abcdefghij'), '#', '') AS slug FROM members""")
register("vote_times", on(lambda t: t.events.select("event_id", records.vote_time(F.concat(F.lit("je_"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("_x"))).alias("at")).select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))), "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
register("gap_fill", on(lambda t: records.gap_fill(_rolls(t).where("chamber = 'House' or motion like 'Brand#1%'").withColumn("id", F.when(F.col("motion").like("Brand#_3"), F.concat(F.lit("kf_"), "id")).otherwise(F.col("id"))).drop("motion"), _rolls(t).drop("motion"), ["bill", "chamber", "day"])), with_views("items") + """
, r AS (SELECT CAST(item AS VARCHAR) AS id, item AS number, bill, chamber, day, motion FROM items), k AS (SELECT * EXCLUDE motion FROM r WHERE (chamber = 'House' OR motion LIKE 'Brand#1%') AND motion NOT LIKE 'Brand#_3')
SELECT * FROM k UNION ALL SELECT 'kf_' || id, number, bill, chamber, day FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.bill = r.bill AND k.chamber = r.chamber AND k.day = r.day)""")


def _rolls(t: Tables) -> DataFrame:
    return t.items.select(F.col("item").cast("string").alias("id"), F.col("item").alias("number"), "bill", "chamber", "day", "motion")


register("resolved_names", on(lambda t: records.resolve_names(t.members.select(F.concat(F.lit("Jo "), F.upper("full_name"), F.when(F.col("district") % 2 == 0, "x").otherwise("")).alias("name")), t.members)), with_views("members") + """
, a AS (SELECT 'Jo ' || upper(full_name) || CASE WHEN district % 2 = 0 THEN 'x' ELSE '' END AS name FROM members) SELECT name, voter, CASE WHEN voter IS NULL THEN 'no_match' ELSE 'ok' END AS status FROM a LEFT JOIN members ON lower(replace(name, 'Jo ', '')) = lower(full_name)""")
register("display_names", on(lambda t: records.display_names(t.members.select("voter", F.concat(F.substring("voter", 5, 1), F.lit("x Name"), (F.col("district") % 7).cast("string")).alias("name"), "chamber"))), with_views("members") + """
, n AS (SELECT voter, substr(voter, 5, 1) AS f, 'Name' || CAST(district % 7 AS VARCHAR) AS l, chamber FROM members) SELECT voter, CASE WHEN count(*) OVER (PARTITION BY chamber, l) > 1 THEN l || ', ' || f ELSE l END AS label FROM n""")
register("district_matches", on(lambda t: records.by_district(t.nation.select((F.col("n_nationkey") % 7).alias("key"), (F.col("n_nationkey") % 7 + 7).alias("district"), F.col("n_name").alias("candidate"), F.col("n_nationkey").alias("candidate_district")))), """
WITH c AS (SELECT n_nationkey % 7 AS key, n_nationkey % 7 + 7 AS d, n_name AS candidate, n_nationkey AS cd, count(*) OVER (PARTITION BY n_nationkey % 7) AS n FROM nation), k AS (SELECT *, count(*) OVER (PARTITION BY key) AS same FROM c WHERE n = 1 OR d = cd) SELECT key, candidate, n AS candidates FROM k WHERE same = 1""")
register("close_names", on(lambda t: records.close_names(t.nation.select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name")), t.nation.select(F.col("n_nationkey").alias("id"), F.concat(F.lower("n_name"), F.lit("x")).alias("name")))), """
WITH p AS (SELECT x.n_nationkey AS id1, z.n_nationkey AS id2, round(1 - levenshtein(lower(x.n_name), lower(z.n_name) || 'x') / CAST(greatest(length(x.n_name), length(z.n_name) + 1) AS DOUBLE), 9) AS similarity FROM nation x CROSS JOIN nation z),
r AS (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY similarity DESC, id2) AS i, row_number() OVER (PARTITION BY id2 ORDER BY similarity DESC, id1) AS j FROM p WHERE similarity >= 0.85) SELECT id1, id2, similarity FROM r WHERE i = 1 AND j = 1""")
TALLY = """, t AS (SELECT item, count(*) FILTER (WHERE choice = 'Yea') AS yea, count(*) FILTER (WHERE choice = 'Nay') AS nay FROM votes GROUP BY 1), r AS (SELECT item AS id, motion, chamber, day, yea, nay FROM items JOIN t USING (item))"""


def _tallies(t: Tables) -> DataFrame:
    counts = t.votes.groupBy("item").agg(F.count(F.when(F.col("choice") == "Yea", 1)).alias("yea"), F.count(F.when(F.col("choice") == "Nay", 1)).alias("nay"))
    return t.items.join(counts, "item").select(F.col("item").alias("id"), "motion", "chamber", "day", "yea", "nay")


register("tally_matches", on(lambda t: records.tally_matches(_tallies(t), _tallies(t).withColumn("id", F.col("id") + 1000000), ["motion", "chamber", "day"])), with_views("items", "votes") + TALLY + """
, n AS (SELECT *, count(*) OVER (PARTITION BY motion, chamber, day) AS n, row_number() OVER (PARTITION BY motion, chamber, day, yea, nay ORDER BY id) AS i FROM r)
SELECT id AS one, id + 1000000 AS two, CASE WHEN n = 1 THEN 'key' ELSE 'tally' END AS "by" FROM n""")


def _votes_of(t: Tables, status: str) -> DataFrame:
    """The votes of one of two sources: lines of one status."""
    once = t.lineitem.where(F.col("l_linestatus") == status).groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("voter")).agg(F.max("l_returnflag").alias("flag"))
    return once.select("item", "voter", F.when(F.col("flag") == "R", "Yea").when(F.col("flag") == "A", "Nay").otherwise("Absent and Not Voting").alias("choice"))


register("vote_differences", on(lambda t: records.vote_differences(_votes_of(t, "F"), _votes_of(t, "O"))), """
WITH v AS (SELECT l_linestatus AS s, l_partkey AS item, l_suppkey AS voter, max(l_returnflag) AS choice FROM lineitem GROUP BY 1, 2, 3), x AS (SELECT * FROM v WHERE s = 'F'), z AS (SELECT * FROM v WHERE s = 'O')
SELECT CASE WHEN x.choice IS NULL THEN 'second only' WHEN z.choice IS NULL THEN 'first only' WHEN x.choice = z.choice THEN 'equal' ELSE 'different' END AS kind, count(*) AS n FROM x FULL JOIN z ON x.item = z.item AND x.voter = z.voter GROUP BY 1""")
register("orders_as_of", on(lambda t: records.as_of(t.events.select(F.col("user_id").alias("person"), "event_id", F.to_date("ts").alias("day")), t.orders.select(F.col("o_custkey").alias("person"), F.add_months(F.to_date("o_orderdate"), 348).alias("day"), "o_orderkey"), ["person"], "day", ["o_orderkey"])), """
WITH e AS (SELECT user_id AS person, event_id, CAST(ts AS DATE) AS day FROM events), o AS (SELECT o_custkey AS person, CAST(CAST(o_orderdate AS DATE) + INTERVAL 348 MONTH AS DATE) AS day, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)
SELECT e.person, e.event_id, e.day, o.o_orderkey FROM e ASOF LEFT JOIN o ON e.person = o.person AND e.day >= o.day""")
register("near_overrides", on(lambda t: records.near_days(t.items.where("motion = 'Brand#11'").select(F.col("item").alias("one"), "day"), t.items.where("motion = 'Brand#22'").select(F.col("item").alias("two"), "day"))), with_views("items") + """
SELECT x.item AS one, z.item AS two, CAST(z.day - x.day AS INTEGER) AS gap FROM items x JOIN items z ON abs(z.day - x.day) <= 14 WHERE x.motion = 'Brand#11' AND z.motion = 'Brand#22'""")

# ---------------------------------------------------------------- comparisons and fit


def _anchors(t: Tables) -> DataFrame:
    shares = agreement.encode(t.votes).join(t.members.select("voter", "chamber"), "voter").groupBy("item", "chamber").agg(F.avg("y").alias("share"))
    house, senate = (shares.where(F.col("chamber") == c).select("item", (1 + F.col("share")).alias(f"a{i}"), F.col("share").alias(f"b{i}")) for i, c in ((1, "House"), (2, "Senate")))
    return house.join(senate, "item")


register("rollcall_codes", on(lambda t: checks.rollcall_codes(t.votes)), with_views("votes") + "SELECT voter, item, CAST(CASE choice WHEN 'Yea' THEN 1 WHEN 'Nay' THEN 6 ELSE 9 END AS INTEGER) AS code FROM votes")
register("polarity_members", on(lambda t: checks.polarity_members(_points(t), t.votes), "xi"), with_views(*VM, more=POS) + """
, att AS (SELECT voter, round(avg(CASE WHEN choice IN ('Yea', 'Nay') THEN 1 ELSE 0 END), 9) AS share FROM votes GROUP BY 1), r AS (SELECT chamber, voter, xi, row_number() OVER (PARTITION BY chamber ORDER BY xi DESC, voter) AS i FROM pos JOIN att USING (voter) WHERE share >= 0.5)
SELECT chamber, voter, round(xi, 6) AS xi FROM r WHERE i = 1""")
register("aligned_positions", on(lambda t: checks.sign_aligned(_both(t).select("voter", "xi", "unity"), "xi", "unity"), "xi", "unity"), with_views(*VM, more=BOTH) + "SELECT voter, round(CASE WHEN corr(xi, unity) OVER () < 0 THEN -xi ELSE xi END, 6) AS xi, round(unity, 6) AS unity FROM both_")
register("score_comparison", on(lambda t: checks.comparison(_both(t), "voter", "xi", "unity", "n"), "xi", "unity"), with_views(*VM, more=BOTH) + """
, r AS (SELECT voter, xi, unity, n, CAST(floor(rank() OVER (ORDER BY xi DESC) + (count(*) OVER (PARTITION BY xi) - 1) / 2.0) AS INTEGER) AS a, CAST(floor(rank() OVER (ORDER BY unity DESC) + (count(*) OVER (PARTITION BY unity) - 1) / 2.0) AS INTEGER) AS b, CAST(floor(rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2.0) AS INTEGER) AS c FROM both_)
SELECT voter, round(xi, 6) AS xi, round(unity, 6) AS unity, n, a AS rank_xi, b AS rank_unity, c AS rank_n, greatest(a, b, c) - least(a, b, c) AS apart FROM r""")
register("linking_constants", on(lambda t: checks.linking_constants(_anchors(t)), "slope", "intercept"), with_views(*VM, more=COO) + """
, s AS (SELECT item, avg(y) FILTER (WHERE chamber = 'House') AS h, avg(y) FILTER (WHERE chamber = 'Senate') AS e FROM coo JOIN members USING (voter) GROUP BY 1), m AS (SELECT avg(1 + h) / avg(1 + e) AS mm, stddev_samp(h) / nullif(stddev_samp(e), 0) AS ms, avg(h) AS h, avg(e) AS e FROM s WHERE h IS NOT NULL AND e IS NOT NULL)
SELECT 'mean/mean' AS method, round(mm, 6) AS slope, round(h - mm * e, 6) AS intercept FROM m UNION ALL SELECT 'mean/sigma', round(ms, 6), round(h - ms * e, 6) FROM m""")
register("top_concordance", on(lambda t: checks.top_concordance(_both(t), "voter", "xi", "unity"), "tau"), with_views(*VM, more=BOTH) + """
, t AS (SELECT voter, xi, unity FROM both_ ORDER BY xi DESC, voter LIMIT 20), p AS (SELECT sign(x.xi - z.xi) AS a, sign(x.unity - z.unity) AS b FROM t x JOIN t z ON x.voter < z.voter)
SELECT count(*) AS pairs, round(sum(a * b) / nullif(sqrt(CAST(sum(abs(a)) * sum(abs(b)) AS DOUBLE)), 0), 6) AS tau FROM p""")
FIT = """, f AS (SELECT {g}, count(*) AS n, CAST(sum(y) AS BIGINT) AS yea, sum(p) AS expected, sqrt(sum(p * (1 - p))) AS sd FROM scored GROUP BY 1)
SELECT {g}, n, yea, round(expected, 6) AS expected, round(sd, 6) AS sd, round((yea - expected) / nullif(sd, 0), 6) AS z, coalesce(abs(round((yea - expected) / nullif(sd, 0), 9)) > 1.959963984540054, false) AS misfit FROM f"""
for _name, _group in (("item_fit", "item"), ("voter_fit", "voter")):
    register(_name, on(lambda t, g=_group: checks.fit_by(catalog._scored(t), g), "expected", "sd", "z"), with_views(*VM, more=FEATURES) + FIT.format(g=_group))
register("surprises_by_class", on(lambda t: checks.surprises_by_class(catalog._scored(t)), "error"), with_views(*VM, more=FEATURES) + """
, w AS (SELECT CASE WHEN y = 0 THEN 'false Yea' ELSE 'false Nay' END AS kind, voter, item, round(abs(p - y), 9) AS error FROM scored WHERE (round(p, 9) >= 0.5) <> (y = 1)), placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY error DESC, voter, item) AS INTEGER) AS place FROM w)
SELECT kind, place, voter, item, round(error, 6) AS error FROM placed WHERE place <= 20""")
