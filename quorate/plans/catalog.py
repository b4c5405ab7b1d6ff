"""Every registered query of the engine, with independent SQL where SQL can express it.

Doubles are rounded to six digits on both sides, because sums differ in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import agreement, align, api, cohesion, graph, integrity, latent, lifecycle, linkage, predict, profiles, ranks, stats, text, timeseries, topics
from ..sources.files import written
from ..streaming import windows
from . import adapter
from .adapter import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


class Tables:
    """The engine's views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if hasattr(adapter, name):
            return getattr(adapter, name)(self.spark, self.dir)
        return adapter.table(self.spark, self.dir, name)


def on(make: Callable[[Tables], DataFrame], *digits: str) -> Query:
    """A query from a function of the views; the named columns are rounded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = make(Tables(spark, sf_dir))
        return rounded(out, *digits) if digits else out

    return run


# ---------------------------------------------------------------- shared SQL fragments

CAST = "cast_votes AS (SELECT * FROM votes WHERE choice IN ('Yea', 'Nay'))"
COUNTS = CAST + """,
counts AS (SELECT item, party, count(*) FILTER (WHERE choice = 'Yea') AS yea, count(*) FILTER (WHERE choice = 'Nay') AS nay, count(*) AS voters
    FROM cast_votes JOIN members USING (voter) GROUP BY item, party)"""
RICED = COUNTS + """,
riced AS (SELECT *, CASE WHEN voters >= 2 THEN abs(yea - nay) / CAST(voters AS DOUBLE) END AS rice FROM counts)"""
SIDES = COUNTS + """,
sides AS (SELECT item, max(yea) FILTER (WHERE party = 'Republican') AS r_yea, max(nay) FILTER (WHERE party = 'Republican') AS r_nay, max(voters) FILTER (WHERE party = 'Republican') AS r_voters,
        max(CASE WHEN yea > nay THEN 'Yea' ELSE 'Nay' END) FILTER (WHERE party = 'Republican') AS r_majority,
        max(yea) FILTER (WHERE party = 'Democrat') AS d_yea, max(nay) FILTER (WHERE party = 'Democrat') AS d_nay, max(voters) FILTER (WHERE party = 'Democrat') AS d_voters,
        max(CASE WHEN yea > nay THEN 'Yea' ELSE 'Nay' END) FILTER (WHERE party = 'Democrat') AS d_majority FROM counts GROUP BY item),
party_votes AS (SELECT *, r_voters >= 2 AND d_voters >= 2 AND r_majority <> d_majority AS party_vote,
        abs(coalesce(r_yea, 0) + coalesce(d_yea, 0) - coalesce(r_nay, 0) - coalesce(d_nay, 0)) / CAST(coalesce(r_voters, 0) + coalesce(d_voters, 0) AS DOUBLE) AS margin FROM sides),
own AS (SELECT item, voter, m.party, choice, CASE WHEN m.party = 'Republican' THEN r_majority ELSE d_majority END AS own,
        CASE WHEN m.party = 'Republican' THEN d_majority ELSE r_majority END AS other, 1 / greatest(margin, 0.01) AS weight
    FROM cast_votes JOIN members m USING (voter) JOIN party_votes USING (item) WHERE party_vote)"""
COO = "coo AS (SELECT voter, item, CASE WHEN choice = 'Yea' THEN 1 ELSE 0 END AS y FROM votes WHERE choice <> 'Absent and Not Voting')"
PAIRS = COO + """,
met AS (SELECT x.voter AS a, z.voter AS b, count(*) AS n, sum(CASE WHEN x.y = z.y THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS agreement, avg(x.y) AS pa, avg(z.y) AS pb
    FROM coo x JOIN coo z ON x.item = z.item AND x.voter < z.voter GROUP BY 1, 2 HAVING count(*) >= 10),
pairs AS (SELECT a, b, n, agreement, CASE WHEN pa * pb + (1 - pa) * (1 - pb) > 1 - 1e-12 THEN 1.0
        ELSE (agreement - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) END AS kappa FROM met)"""
#: Votes of the test tables are random with respect to party, so links are weak.
KAPPA = 0.05
GRAPH = PAIRS + f""",
edges AS (SELECT a, b, kappa AS weight FROM pairs WHERE kappa > {KAPPA}),
ends AS (SELECT a, b, weight FROM edges UNION ALL SELECT b, a, weight FROM edges),
degrees AS (SELECT a AS voter, count(*) AS degree, sum(weight) AS strength FROM ends GROUP BY a)"""
VM = ("members", "votes")


def _pairs(t: Tables) -> DataFrame:
    """Pairs of voters, written once: graphs read them several times."""
    return written(agreement.pairs(agreement.encode(t.votes)))


def _graph(t: Tables) -> DataFrame:
    return graph.edges(_pairs(t), KAPPA)


def _compared(pairs: DataFrame) -> DataFrame:
    return graph.compare(graph.disparity(graph.edges(pairs, KAPPA), 0.3), graph.edges(pairs, 0.1))


def _counts(t: Tables) -> DataFrame:
    return cohesion.party_counts(t.votes, t.members)


def _riced(t: Tables) -> DataFrame:
    return cohesion.rice(_counts(t), 2)


# ---------------------------------------------------------------- integrity

register("session_summary", on(lambda t: integrity.summary(t.votes, t.items, t.members)), with_views("members", "items") + """
SELECT i.chamber, i.items, i.bills, i.first_day, i.last_day, m.members FROM (SELECT chamber, count(*) AS items, count(DISTINCT bill) AS bills, min(day) AS first_day, max(day) AS last_day FROM items GROUP BY chamber) i
LEFT JOIN (SELECT chamber, count(*) AS members FROM members GROUP BY chamber) m ON i.chamber = m.chamber""")
register("choice_counts", on(lambda t: integrity.choice_counts(t.votes)), with_views("votes") + "SELECT choice, count(*) AS n, count(DISTINCT voter) AS voters, count(DISTINCT item) AS items FROM votes GROUP BY choice")
register("seat_counts", on(lambda t: integrity.seats(t.members)), with_views("members") + "SELECT chamber, party, count(*) AS seats, count(DISTINCT district) AS districts FROM members GROUP BY 1, 2")
register("service_overlap", on(lambda t: integrity.overlapping_service(t.votes, t.items, t.members)), with_views("members", "items", "votes") + """,
spans AS (SELECT voter, min(day) AS first_day, max(day) AS last_day FROM votes JOIN items USING (item) GROUP BY voter),
seq AS (SELECT chamber, district, voter, last_day, lead(voter) OVER w AS next_voter, lead(first_day) OVER w AS next_first FROM members JOIN spans USING (voter) WINDOW w AS (PARTITION BY chamber, district ORDER BY first_day, voter))
SELECT chamber, district, voter, next_voter, last_day, next_first FROM seq WHERE last_day >= next_first""")
register("orphan_keys", on(lambda t: integrity.orphans(t.votes, t.items, t.members)), with_views("members", "items", "votes") + """
SELECT 'vote without member' AS kind, voter AS key FROM (SELECT DISTINCT voter FROM votes EXCEPT SELECT voter FROM members)
UNION ALL SELECT 'member without vote', voter FROM (SELECT voter FROM members EXCEPT SELECT voter FROM votes)
UNION ALL SELECT 'vote without item', CAST(item AS VARCHAR) FROM (SELECT item FROM votes EXCEPT SELECT item FROM items)
UNION ALL SELECT 'item without vote', CAST(item AS VARCHAR) FROM (SELECT item FROM items EXCEPT SELECT item FROM votes)""")
register("repeated_votes", on(lambda t: integrity.repeated(t.votes_raw, "item", "l_suppkey")), "SELECT l_partkey AS item, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
register("tally_gaps", on(lambda t: integrity.tally_gaps(t.votes_raw, t.votes)), with_views("votes") + """
SELECT a.item, a.rows, b.votes, b.yea, b.nay, a.rows - b.votes AS gap FROM (SELECT l_partkey AS item, count(*) AS rows FROM lineitem GROUP BY 1) a
JOIN (SELECT item, count(*) AS votes, count(*) FILTER (WHERE choice = 'Yea') AS yea, count(*) FILTER (WHERE choice = 'Nay') AS nay FROM votes GROUP BY 1) b ON a.item = b.item WHERE a.rows <> b.votes""")
register("domain_check", on(lambda t: integrity.outside_domain(t.votes, t.members)), with_views("members", "votes") + """
SELECT 'choice' AS rule, count(*) AS n FROM votes WHERE choice NOT IN ('Yea', 'Nay', 'Absent and Not Voting')
UNION ALL SELECT 'prefix', count(*) FROM members WHERE CASE WHEN voter LIKE 'sen%' THEN 'Senate' ELSE 'House' END <> chamber""")
register("near_duplicate_items", on(lambda t: integrity.near_duplicate_items(t.votes)), with_views("votes", more=COO) + """
, kept AS (SELECT item FROM coo GROUP BY item HAVING least(avg(y), 1 - avg(y)) >= 0.1), c AS (SELECT * FROM coo WHERE item IN (SELECT item FROM kept))
SELECT x.item AS a, z.item AS b, count(*) AS common, CAST(sum(abs(x.y - z.y)) AS BIGINT) AS differ FROM c x JOIN c z ON x.voter = z.voter AND x.item < z.item GROUP BY 1, 2 HAVING count(*) >= 10 AND sum(abs(x.y - z.y)) <= 1""")

# ---------------------------------------------------------------- cohesion

register("rice_cohesion", on(lambda t: cohesion.rice(_counts(t)), "rice"), with_views(*VM, more=COUNTS) + "SELECT *, round(abs(yea - nay) / CAST(voters AS DOUBLE), 6) AS rice FROM counts")
register("rice_index", on(lambda t: cohesion.rice(cohesion.party_counts(t.votes, t.members, "left"), 2), "rice"), with_views(*VM, more=CAST) + """
SELECT item, party, count(*) FILTER (WHERE choice = 'Yea') AS yea, count(*) FILTER (WHERE choice = 'Nay') AS nay, count(*) AS voters,
CASE WHEN count(*) >= 2 THEN round(abs(count(*) FILTER (WHERE choice = 'Yea') - count(*) FILTER (WHERE choice = 'Nay')) / CAST(count(*) AS DOUBLE), 6) END AS rice
FROM cast_votes LEFT JOIN members USING (voter) GROUP BY item, party""")
register("rice_summary", on(lambda t: cohesion.rice_summary(_riced(t)), "mean", "median", "std", "least", "most", "perfect", "fractured"), with_views(*VM, more=RICED) + """
SELECT party, count(*) AS n, round(avg(rice), 6) AS mean, round(median(rice), 6) AS median, round(stddev_samp(rice), 6) AS std, round(min(rice), 6) AS least, round(max(rice), 6) AS most,
round(avg(CASE WHEN rice = 1 THEN 1 ELSE 0 END), 6) AS perfect, round(avg(CASE WHEN rice < 0.5 THEN 1 ELSE 0 END), 6) AS fractured FROM riced WHERE rice IS NOT NULL GROUP BY party""")
register("rice_by_motion", on(lambda t: cohesion.rice_by_motion(_riced(t), t.items), "mean", "median", "std"), with_views("items", *VM, more=RICED) + """
SELECT motion, party, count(*) AS n, round(avg(rice), 6) AS mean, round(median(rice), 6) AS median, round(stddev_samp(rice), 6) AS std FROM riced JOIN items USING (item) WHERE rice IS NOT NULL GROUP BY 1, 2""")
register("fractured_items", on(lambda t: cohesion.fractured_items(_riced(t)), "rice"), with_views(*VM, more=RICED) + """
SELECT item, party, yea, nay, voters, round(rice, 6) AS rice FROM riced WHERE rice < 0.5 AND party = (SELECT party FROM riced GROUP BY party ORDER BY avg(voters) DESC, party LIMIT 1)""")
register("party_majorities", on(lambda t: cohesion.with_majority(_counts(t)), "yea_share"), with_views(*VM, more=COUNTS) + "SELECT *, CASE WHEN yea > nay THEN 'Yea' ELSE 'Nay' END AS majority, round(yea / CAST(voters AS DOUBLE), 6) AS yea_share FROM counts")
register("party_votes", on(lambda t: cohesion.party_votes(_counts(t)), "margin", "weight"), with_views(*VM, more=SIDES) + "SELECT item, r_yea, r_nay, r_voters, r_majority, d_yea, d_nay, d_voters, d_majority, party_vote, round(margin, 6) AS margin, round(1 / greatest(margin, 0.01), 6) AS weight FROM party_votes")
LINES = COUNTS + """,
shares AS (SELECT item, max(yea / CAST(voters AS DOUBLE)) FILTER (WHERE party = 'Republican') AS r, max(yea / CAST(voters AS DOUBLE)) FILTER (WHERE party = 'Democrat') AS d FROM counts GROUP BY item),
kinds AS (SELECT *, CASE WHEN (r > {h} AND d < 1 - {h}) OR (r < 1 - {h} AND d > {h}) THEN 'party-line' WHEN (r > {h} AND d > {h}) OR (r < 1 - {h} AND d < 1 - {h}) THEN 'bipartisan' ELSE 'mixed' END AS kind FROM shares)"""
register("line_class", on(lambda t: cohesion.line_class(_counts(t), 0.75), "r", "d"), with_views(*VM, more=LINES.format(h="CAST(0.75 AS DOUBLE)")) + "SELECT item, round(r, 6) AS r, round(d, 6) AS d, kind FROM kinds")
register("line_unity", on(lambda t: cohesion.line_unity(t.votes, t.members, 0.7), "unity"), with_views(*VM, more=LINES.format(h="CAST(0.7 AS DOUBLE)")) + """
SELECT voter, m.party, count(*) AS line_votes, round(avg(CASE WHEN choice = CASE WHEN c.yea >= c.nay THEN 'Yea' ELSE 'Nay' END THEN 1 ELSE 0 END), 6) AS unity
FROM cast_votes v JOIN members m USING (voter) JOIN kinds k ON k.item = v.item AND kind = 'party-line' JOIN counts c ON c.item = v.item AND c.party = m.party GROUP BY 1, 2""")
UNITY = SIDES + """,
united AS (SELECT voter, party, count(*) AS party_votes, count(*) FILTER (WHERE choice <> own) AS defections, sum(CASE WHEN choice <> own THEN weight ELSE 0 END) / sum(weight) AS weighted_maverick,
    count(*) FILTER (WHERE choice <> own) / CAST(count(*) AS DOUBLE) AS maverick, 1 - count(*) FILTER (WHERE choice <> own) / CAST(count(*) AS DOUBLE) AS unity FROM own GROUP BY 1, 2)"""
register("unity_maverick", on(lambda t: cohesion.unity(t.votes, t.members), "weighted_maverick", "maverick", "unity", "z"), with_views(*VM, more=UNITY) + """
SELECT voter, party, party_votes, defections, round(weighted_maverick, 6) AS weighted_maverick, round(maverick, 6) AS maverick, round(unity, 6) AS unity,
round(CASE WHEN count(*) OVER p < 3 THEN NULL WHEN stddev_samp(unity) OVER p < 1e-10 THEN 0.0 ELSE (unity - avg(unity) OVER p) / stddev_samp(unity) OVER p END, 6) AS z FROM united WINDOW p AS (PARTITION BY party)""")
register("carey_unity", on(lambda t: cohesion.carey(t.votes, t.members), "carey"), with_views(*VM, more=COUNTS) + """
SELECT item, party, yea, nay, voters, members, round(abs(yea - nay) / CAST(members AS DOUBLE), 6) AS carey, members - yea - nay AS absent FROM counts JOIN (SELECT party, count(*) AS members FROM members GROUP BY party HAVING count(*) >= 2) USING (party)""")
register("effective_parties", on(lambda t: cohesion.effective_parties(t.members), "enp"), with_views("members") + """
SELECT chamber, round(1 / sum((n / CAST(t AS DOUBLE)) * (n / CAST(t AS DOUBLE))), 6) AS enp, CAST(sum(n) AS BIGINT) AS seats FROM (SELECT chamber, party, count(*) AS n, sum(count(*)) OVER (PARTITION BY chamber) AS t FROM members GROUP BY 1, 2) GROUP BY chamber""")
register("effective_blocs", on(lambda t: cohesion.effective_blocs(t.votes, t.members), "enp"), with_views(*VM, more=CAST) + """
SELECT item, round(1 / sum((n / CAST(t AS DOUBLE)) * (n / CAST(t AS DOUBLE))), 6) AS enp, count(*) AS blocs FROM (SELECT item, party, choice, count(*) AS n, sum(count(*)) OVER (PARTITION BY item) AS t FROM cast_votes JOIN members USING (voter) GROUP BY 1, 2, 3) GROUP BY item""")
register("bipartisanship", on(lambda t: cohesion.bipartisanship(t.votes, t.members), "bpi"), with_views(*VM, more=SIDES) + "SELECT voter, party, count(*) AS party_votes, round(avg(CASE WHEN choice = other THEN 1 ELSE 0 END), 6) AS bpi FROM own GROUP BY 1, 2")
register("plus_minus", on(lambda t: cohesion.plus_minus(cohesion.unity(t.votes, t.members)).select("voter", "party", "unity", "plus_minus"), "unity", "plus_minus"), with_views(*VM, more=UNITY) + "SELECT voter, party, round(unity, 6) AS unity, round(unity - avg(unity) OVER (PARTITION BY party), 6) AS plus_minus FROM united")
register("co_defection", on(lambda t: cohesion.co_defection(t.votes, t.members)), with_views(*VM, more=SIDES) + """
, d AS (SELECT * FROM own WHERE choice <> own AND party = (SELECT party FROM members GROUP BY party ORDER BY count(*) DESC, party LIMIT 1)),
top AS (SELECT voter FROM d GROUP BY voter ORDER BY count(*) DESC, voter LIMIT 20), k AS (SELECT item, voter FROM d WHERE voter IN (SELECT voter FROM top))
SELECT x.voter AS a, z.voter AS b, count(*) AS shared FROM k x JOIN k z ON x.item = z.item AND x.voter < z.voter GROUP BY 1, 2 HAVING count(*) >= 3""")
register("perfect_partisans", on(lambda t: cohesion.perfect_partisans(t.votes, t.members), "with_party"), with_views(*VM, more=COUNTS) + """
SELECT voter, m.party, count(*) AS n, round(avg(CASE WHEN choice = CASE WHEN yea >= nay THEN 'Yea' ELSE 'Nay' END THEN 1 ELSE 0 END), 6) AS with_party,
min(CASE WHEN choice = CASE WHEN yea >= nay THEN 'Yea' ELSE 'Nay' END THEN 1 ELSE 0 END) = 1 AND count(*) >= 50 AS perfect FROM cast_votes v JOIN members m USING (voter) JOIN counts c ON c.item = v.item AND c.party = m.party GROUP BY 1, 2""")
register("strategic_absence", on(lambda t: cohesion.strategic_absence(t.votes, t.members), "overall", "on_line", "ratio"), with_views(*VM, more=SIDES) + """
, r AS (SELECT v.voter, m.party, CASE WHEN choice LIKE 'Absent%' THEN 1 ELSE 0 END AS away, p.item IS NOT NULL AS line FROM votes v JOIN members m USING (voter) LEFT JOIN (SELECT item FROM party_votes WHERE party_vote) p ON p.item = v.item),
s AS (SELECT voter, party, avg(away) AS overall, avg(away) FILTER (WHERE line) AS on_line, count(*) FILTER (WHERE line AND away = 1) AS absences FROM r GROUP BY 1, 2)
SELECT voter, party, round(overall, 6) AS overall, round(on_line, 6) AS on_line, absences, round(on_line / nullif(overall, 0), 6) AS ratio, coalesce(on_line / nullif(overall, 0) >= 2 AND absences >= 3, false) AS strategic FROM s""")
register("participation", on(lambda t: cohesion.participation(t.votes, t.members), "rate"), with_views(*VM) + """
SELECT chamber, voter, party, "cast", listed, items, round("cast" / CAST(items AS DOUBLE), 6) AS rate FROM (SELECT chamber, voter, party, count(*) FILTER (WHERE choice NOT LIKE 'Absent%') AS "cast", count(*) AS listed FROM votes JOIN members USING (voter) GROUP BY 1, 2, 3)
JOIN (SELECT chamber, count(DISTINCT item) AS items FROM votes JOIN members USING (voter) GROUP BY 1) USING (chamber)""")
register("choice_breakdown", on(lambda t: cohesion.choice_breakdown(t.votes, t.members)), with_views(*VM) + "SELECT party, choice, count(*) AS n FROM votes JOIN members USING (voter) GROUP BY ROLLUP (party, choice)")
register("party_loyalty", on(lambda t: cohesion.loyalty(t.votes, t.members), "loyalty"), with_views(*VM, more=COUNTS) + """
SELECT voter, m.party, count(*) AS contested, round(avg(CASE WHEN choice = CASE WHEN yea > nay THEN 'Yea' ELSE 'Nay' END THEN 1 ELSE 0 END), 6) AS loyalty FROM cast_votes v JOIN members m USING (voter) JOIN counts c ON c.item = v.item AND c.party = m.party
WHERE least(yea / CAST(voters AS DOUBLE), 1 - yea / CAST(voters AS DOUBLE)) >= 0.1 GROUP BY 1, 2""")
register("chance_corrected_rice", on(lambda t: rounded(cohesion.expected_rice(_counts(t)), "rice", "chance", "excess", digits=4)), with_views(*VM, more=COUNTS) + """
, m AS (SELECT DISTINCT voters, voters // 2 AS h FROM counts), f AS (SELECT voters, exp(coalesce((SELECT sum(ln((2 * k - 1) / (2.0 * k))) FROM range(1, 100000) r(k) WHERE k <= h), 0.0)) AS chance FROM m)
SELECT item, party, yea, nay, voters, round(abs(yea - nay) / CAST(voters AS DOUBLE), 4) AS rice, round(chance, 4) AS chance, round(abs(yea - nay) / CAST(voters AS DOUBLE) - chance, 4) AS excess FROM counts JOIN f USING (voters)""")
register("item_polarization", on(lambda t: cohesion.item_polarization(t.votes, t.members), "r_share", "d_share", "polarization"), with_views(*VM, more=COUNTS) + """
SELECT item, round(r, 6) AS r_share, round(d, 6) AS d_share, voters, round(abs(r - d), 6) AS polarization FROM (SELECT item, max(yea / CAST(voters AS DOUBLE)) FILTER (WHERE party = 'Republican') AS r,
max(yea / CAST(voters AS DOUBLE)) FILTER (WHERE party = 'Democrat') AS d, CAST(sum(voters) AS BIGINT) AS voters FROM counts GROUP BY item) WHERE voters >= 10 AND r IS NOT NULL AND d IS NOT NULL""")

# ---------------------------------------------------------------- encoding and agreement

FILTERED = COO + """,
first AS (SELECT * FROM coo WHERE item IN (SELECT item FROM coo GROUP BY item HAVING least(avg(y), 1 - avg(y)) >= 0.3)),
filtered AS (SELECT * FROM first WHERE voter IN (SELECT voter FROM first GROUP BY voter HAVING count(*) >= 20))"""
register("encoded_votes", on(lambda t: agreement.encode(t.votes)), with_views("votes", more=COO) + "SELECT * FROM coo")
register("contested_matrix", on(lambda t: agreement.contested_only(agreement.encode(t.votes), 0.3)), with_views("votes", more=FILTERED) + "SELECT * FROM filtered")
register("matrix_sparsity", on(lambda t: agreement.sparsity(agreement.encode(t.votes)), "sparsity"), with_views("votes", more=COO) + "SELECT count(*) AS cells, count(DISTINCT voter) AS voters, count(DISTINCT item) AS items, round(1 - count(*) / CAST(count(DISTINCT voter) * count(DISTINCT item) AS DOUBLE), 6) AS sparsity FROM coo")
register("item_total_correlation", on(lambda t: agreement.item_total(agreement.encode(t.votes)), "r"), with_views("votes", more=COO) + """
, r AS (SELECT *, avg(y) OVER (PARTITION BY voter) AS rate FROM coo), c AS (SELECT item, count(*) AS n, avg(y * rate) - avg(y) * avg(rate) AS cov, avg(y * y) - avg(y) * avg(y) AS va, avg(rate * rate) - avg(rate) * avg(rate) AS vb FROM r GROUP BY item)
SELECT item, n, round(CASE WHEN va > 1e-12 AND vb > 1e-12 THEN cov / sqrt(va * vb) ELSE 0.0 END, 6) AS r, abs(CASE WHEN va > 1e-12 AND vb > 1e-12 THEN cov / sqrt(va * vb) ELSE 0.0 END) < 0.1 AS low FROM c WHERE n >= 5""")
register("imputed_rates", on(lambda t: agreement.imputed_rates(agreement.encode(t.votes)), "fill"), with_views("votes", more=COO) + "SELECT voter, round(avg(y), 6) AS fill, count(*) AS known FROM coo GROUP BY voter")
register("agreement_pairs", on(lambda t: agreement.pairs(agreement.encode(t.votes)), "agreement", "kappa"), with_views("votes", more=PAIRS) + "SELECT a, b, n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa FROM pairs")
register("agreement_neighbours", on(lambda t: agreement.neighbours(_pairs(t).withColumn("agreement", F.round("agreement", 9))), "agreement"), with_views("votes", more=PAIRS) + """
, both_ways AS (SELECT a, b, n, round(agreement, 9) AS agreement FROM pairs UNION ALL SELECT b, a, n, round(agreement, 9) FROM pairs), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY agreement DESC, n DESC, b) AS INTEGER) AS place FROM both_ways)
SELECT a, place, b, n, round(agreement, 6) AS agreement FROM ranked WHERE place <= 5""")

# ---------------------------------------------------------------- lifecycle and time

STAGE = """staged AS (SELECT *, CASE WHEN status LIKE '%signup%' THEN 'Introduced' WHEN status LIKE '%view%' THEN 'Referral' WHEN status LIKE '%click%' THEN 'Hearing' WHEN status LIKE '%error%' THEN 'Failed' WHEN status LIKE '%purchase%' THEN 'Enacted' ELSE 'Other' END AS stage FROM actions)"""
#: Kinds of the event table, as stages.
EVENT_STAGES = [("Introduced", ("signup",)), ("Referral", ("view",)), ("Hearing", ("click",)), ("Failed", ("error",)), ("Enacted", ("purchase",))]
register("stage_counts", on(lambda t: lifecycle.stage_counts(t.actions, EVENT_STAGES)), with_views("actions", more=STAGE) + "SELECT stage, count(*) AS n, count(DISTINCT bill) AS bills FROM staged GROUP BY stage")
register("stage_transitions", on(lambda t: lifecycle.transitions(t.actions, EVENT_STAGES, ("Enacted", "Failed"))), with_views("actions", more=STAGE) + """
, l AS (SELECT *, lag(stage) OVER (PARTITION BY bill ORDER BY ts, event_id) AS before FROM staged), s AS (SELECT bill, ts, event_id, stage FROM l WHERE before IS NULL OR before <> stage),
t AS (SELECT stage AS source, lead(stage) OVER (PARTITION BY bill ORDER BY ts, event_id) AS target FROM s)
SELECT source, CASE WHEN target IS NULL THEN 'Died' ELSE target END AS target, count(*) AS n FROM t WHERE target IS NOT NULL OR source NOT IN ('Enacted', 'Failed') GROUP BY 1, 2""")
register("bill_durations", on(lambda t: lifecycle.durations(t.actions)), with_views("actions") + "SELECT bill, count(*) AS actions, CAST(date_diff('day', min(ts), max(ts)) AS INTEGER) AS days, count(DISTINCT status) AS kinds FROM actions GROUP BY bill")
register("weekly_rice", on(lambda t: timeseries.windowed_rice(_riced(t), t.items), "mean"), with_views("items", *VM, more=RICED) + """
SELECT CAST(time_bucket(INTERVAL 7 days, CAST(day AS TIMESTAMP), TIMESTAMP '1970-01-01') AS DATE) AS start, party, round(avg(rice), 6) AS mean, count(*) AS n FROM riced JOIN items USING (item) WHERE rice IS NOT NULL GROUP BY 1, 2""")
register("moving_rice", on(lambda t: timeseries.moving_average(_riced(t), t.items), "mean"), with_views("items", *VM, more=RICED) + """
, w AS (SELECT party, day, item, avg(rice) OVER o AS mean, count(*) OVER o AS n FROM riced JOIN items USING (item) WHERE rice IS NOT NULL WINDOW o AS (PARTITION BY party ORDER BY day, item ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))
SELECT party, day, item, round(mean, 6) AS mean FROM w WHERE n = 15""")
register("monthly_votes", on(lambda t: timeseries.monthly(t.votes, t.items)), with_views("items", "votes") + """
SELECT strftime(day, '%Y-%m') AS month, count(*) FILTER (WHERE choice = 'Yea') AS yea, count(*) FILTER (WHERE choice = 'Nay') AS nay, count(*) FILTER (WHERE choice LIKE 'Absent%') AS absent FROM votes JOIN items USING (item) GROUP BY 1""")
register("count_windows", on(lambda t: timeseries.count_windows(_riced(t), t.items), "mean"), with_views("items", *VM, more=RICED) + """
, p AS (SELECT party, rice, row_number() OVER (PARTITION BY party ORDER BY day, item) - 1 AS i, count(*) OVER (PARTITION BY party) AS total FROM riced JOIN items USING (item) WHERE rice IS NOT NULL)
SELECT party, w.k AS "window", round(avg(rice), 6) AS mean, count(*) AS n FROM p JOIN range(0, 100000) w(k) ON i >= k * 15 AND i < k * 15 + 75 AND k * 15 + 75 <= total GROUP BY 1, 2""")
register("halves", on(lambda t: timeseries.halves(_riced(t), t.items), "early", "late", "change"), with_views("items", *VM, more=RICED) + """
, p AS (SELECT party, rice, row_number() OVER (PARTITION BY party ORDER BY day, item) * 2 <= count(*) OVER (PARTITION BY party) AS early FROM riced JOIN items USING (item) WHERE rice IS NOT NULL)
SELECT party, round(avg(rice) FILTER (WHERE early), 6) AS early, round(avg(rice) FILTER (WHERE NOT early), 6) AS late, round(avg(rice) FILTER (WHERE NOT early) - avg(rice) FILTER (WHERE early), 6) AS change FROM p GROUP BY party""")
register("day_of_session", on(lambda t: timeseries.day_of_session(t.items)), with_views("items") + "SELECT item, chamber, CAST(day - min(day) OVER (PARTITION BY chamber) AS INTEGER) AS day_of_session FROM items")
register("close_dates", on(lambda t: timeseries.close_pairs(t.items.select(F.col("item").alias("key"), "day"))), with_views("items") + """
, k AS (SELECT item AS key, day FROM items) SELECT x.key AS a, z.key AS b, CAST(z.day - x.day AS INTEGER) AS gap FROM k x JOIN k z ON x.key < z.key AND abs(z.day - x.day) <= 14""")
register("change_points", on(lambda t: timeseries.change_points(timeseries.moving_average(_riced(t), t.items).withColumn("place", F.expr("row_number() over (partition by party order by day, item)").cast("long")).select("party", "place", F.col("mean").alias("value")))))

# ---------------------------------------------------------------- sessions

BRIDGES = "bridged AS (SELECT x.person, x.session, x.score, z.score AS after FROM sessions x JOIN sessions z ON x.person = z.person AND z.session = x.session + 1)"
RANKS = BRIDGES + """,
ranked AS (SELECT *, rank() OVER (PARTITION BY session ORDER BY score) + (count(*) OVER (PARTITION BY session, score) - 1) / 2.0 AS rb, rank() OVER (PARTITION BY session ORDER BY after) + (count(*) OVER (PARTITION BY session, after) - 1) / 2.0 AS ra FROM bridged)"""
register("session_scores", on(lambda t: t.sessions, "score"), with_views("sessions") + "SELECT person, session, round(score, 6) AS score FROM sessions")
register("session_counts", on(lambda t: api.session_counts(t.sessions)), with_views("sessions") + "SELECT session, count(DISTINCT person) AS persons, count(*) AS rows FROM sessions GROUP BY session")
register("turnover", on(lambda t: align.turnover(t.sessions)), with_views("sessions") + """
SELECT coalesce(x.session, z.session - 1) AS session, count(*) FILTER (WHERE x.person IS NOT NULL AND z.person IS NOT NULL) AS stayed, count(*) FILTER (WHERE z.person IS NULL) AS "left", count(*) FILTER (WHERE x.person IS NULL) AS came
FROM sessions x FULL JOIN sessions z ON x.person = z.person AND z.session = x.session + 1 GROUP BY 1""")
register("session_links", on(lambda t: align.links(align.bridges(t.sessions)), "slope", "intercept"), with_views("sessions", more=BRIDGES) + """
, f AS (SELECT session, regr_slope(after, score) AS m, regr_intercept(after, score) AS c FROM bridged GROUP BY session), r AS (SELECT *, abs(after - m * score - c) AS off FROM bridged JOIN f USING (session)),
o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY off, person) AS i, count(*) OVER (PARTITION BY session) AS n FROM r)
SELECT session, max(n) AS bridges, count(*) AS used, round(CASE WHEN max(n) >= 20 THEN regr_slope(after, score) ELSE 1.0 END, 6) AS slope, round(CASE WHEN max(n) >= 20 THEN regr_intercept(after, score) ELSE 0.0 END, 6) AS intercept FROM o WHERE i <= floor(n * (1 - 0.1)) GROUP BY session""")


def _ranked_bridges(t: Tables) -> DataFrame:
    """Bridges whose scores are free of the last bits that the order of a sum leaves, so equal means are ties."""
    return align.bridges(t.sessions.withColumn("score", F.round("score", 6)))


register("rank_shifts", on(lambda t: align.shifts(_ranked_bridges(t)), "rank_before", "rank_after", "shift"), with_views("sessions", more=RANKS) + """
SELECT person, session, round(CAST(rb AS DOUBLE), 6) AS rank_before, round(CAST(ra AS DOUBLE), 6) AS rank_after, round(CAST(ra - rb AS DOUBLE), 6) AS shift, coalesce(abs(ra - rb) > stddev_samp(ra - rb) OVER (PARTITION BY session), false) AS mover FROM ranked""")
register("session_stability", on(lambda t: align.stability(_ranked_bridges(t)), "pearson", "spearman"), with_views("sessions", more=RANKS) + "SELECT session, count(*) AS n, round(corr(score, after), 6) AS pearson, round(corr(rb, ra), 6) AS spearman FROM ranked GROUP BY session")
register("mean_decomposition", on(lambda t: align.decomposition(t.sessions), "total", "within", "replacement"), with_views("sessions", more=BRIDGES) + """
, m AS (SELECT session, avg(score) AS mean FROM sessions GROUP BY session), b AS (SELECT session, avg(after) - avg(score) AS within FROM bridged GROUP BY session)
SELECT x.session, round(z.mean - x.mean, 6) AS total, round(within, 6) AS within, round(z.mean - x.mean - within, 6) AS replacement FROM m x JOIN m z ON z.session = x.session + 1 LEFT JOIN b ON b.session = x.session""")
register("career_scores", on(lambda t: align.careers(t.sessions.withColumn("score", F.col("score") / 1000)), "career", "error", "tau2", "i2"), with_views("sessions") + """
, s AS (SELECT person, session, score / 1000 AS score FROM sessions), e AS (SELECT session, var_samp(score) / count(*) AS v FROM s GROUP BY session), r AS (SELECT person, score, v, 1 / v AS w FROM s JOIN e USING (session) WHERE v > 0),
f AS (SELECT person, count(*) AS k, sum(w) AS sw, sum(w * w) AS sw2, sum(w * score) / sum(w) AS fixed FROM r GROUP BY person),
q AS (SELECT person, k, sw, sw2, sum(w * (score - fixed) * (score - fixed)) AS q FROM r JOIN f USING (person) GROUP BY 1, 2, 3, 4),
t AS (SELECT person, k, q, CASE WHEN k > 1 AND sw - sw2 / sw > 0 THEN greatest(0.0, (q - (k - 1)) / (sw - sw2 / sw)) ELSE 0.0 END AS tau2 FROM q)
SELECT person, max(k) AS sessions, round(sum(score / (v + tau2)) / sum(1 / (v + tau2)), 6) AS career, round(1 / sqrt(sum(1 / (v + tau2))), 6) AS error, round(max(tau2), 6) AS tau2,
round(CASE WHEN max(k) > 1 THEN coalesce(greatest(0.0, (max(q) - (max(k) - 1)) / nullif(max(q), 0)), 0.0) ELSE 0.0 END, 6) AS i2 FROM r JOIN t USING (person) GROUP BY person""")
register("population_shift", on(lambda t: align.population_shift(t.sessions), "psi"), with_views("sessions") + """
, cuts AS (SELECT session, quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM sessions GROUP BY session),
b AS (SELECT s.session, len(list_filter(c, lambda x: x < score)) AS bin, 1 AS e, 0 AS a FROM sessions s JOIN cuts USING (session) UNION ALL SELECT cuts.session, len(list_filter(c, lambda x: x < score)), 0, 1 FROM sessions s JOIN cuts ON cuts.session = s.session - 1),
n AS (SELECT session, bin, sum(e) AS e, sum(a) AS a FROM b GROUP BY 1, 2), t AS (SELECT *, sum(e) OVER (PARTITION BY session) AS te, sum(a) OVER (PARTITION BY session) AS ta FROM n),
p AS (SELECT session, greatest(e / CAST(te AS DOUBLE), 1e-4) AS pe, greatest(a / CAST(ta AS DOUBLE), 1e-4) AS pa FROM t WHERE te > 0 AND ta > 0)
SELECT session, round(sum((pa - pe) * ln(pa / pe)), 6) AS psi FROM p GROUP BY session""")
register("intraclass", on(lambda t: align.intraclass(align.bridges(t.sessions)), "icc"), with_views("sessions", more=BRIDGES) + """
, g AS (SELECT *, (score + after) / 2 AS m, avg((score + after) / 2) OVER (PARTITION BY session) AS gm FROM bridged),
s AS (SELECT session, count(*) AS n, 2 * sum((m - gm) * (m - gm)) AS ssb, sum((score - m) * (score - m) + (after - m) * (after - m)) AS ssw FROM g GROUP BY session)
SELECT session, n, round((ssb / nullif(n - 1, 0) - ssw / n) / nullif(ssb / nullif(n - 1, 0) + ssw / n, 0), 6) AS icc FROM s""")

# ---------------------------------------------------------------- statistics

register("unity_outliers", on(lambda t: stats.outliers(cohesion.unity(t.votes, t.members).select("voter", "party", "unity"), "unity", "party", 1.5), "unity", "z"), with_views(*VM, more=UNITY) + """
, z AS (SELECT voter, party, unity, (unity - avg(unity) OVER (PARTITION BY party)) / nullif(stddev_pop(unity) OVER (PARTITION BY party), 0) AS z FROM united) SELECT voter, party, round(unity, 6) AS unity, round(z, 6) AS z FROM z WHERE abs(z) > 1.5""")
register("party_effect_size", on(lambda t: stats.cohens_d(cohesion.unity(t.votes, t.members), "unity", "party", *cohesion.PARTIES), "d"), with_views(*VM, more=UNITY) + """
SELECT n1, n2, round((m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 0), 6) AS d FROM (SELECT count(*) FILTER (WHERE party = 'Republican') AS n1, count(*) FILTER (WHERE party = 'Democrat') AS n2, avg(unity) FILTER (WHERE party = 'Republican') AS m1,
avg(unity) FILTER (WHERE party = 'Democrat') AS m2, var_samp(unity) FILTER (WHERE party = 'Republican') AS v1, var_samp(unity) FILTER (WHERE party = 'Democrat') AS v2 FROM united)""")
register("unity_participation_correlation", on(lambda t: stats.correlation(cohesion.unity(t.votes, t.members).join(cohesion.participation(t.votes, t.members).select("voter", "rate"), "voter"), "unity", "rate"), "pearson", "spearman", "low", "high"), with_views(*VM, more=UNITY) + """
, c AS (SELECT chamber, count(DISTINCT item) AS items FROM votes JOIN members USING (voter) GROUP BY 1), r AS (SELECT voter, chamber, count(*) FILTER (WHERE choice NOT LIKE 'Absent%') AS n FROM votes JOIN members USING (voter) GROUP BY 1, 2),
x AS (SELECT unity, n / CAST(items AS DOUBLE) AS rate FROM united JOIN r USING (voter) JOIN c USING (chamber)),
k AS (SELECT *, rank() OVER (ORDER BY unity) + (count(*) OVER (PARTITION BY unity) - 1) / 2.0 AS ru, rank() OVER (ORDER BY rate) + (count(*) OVER (PARTITION BY rate) - 1) / 2.0 AS rr FROM x), s AS (SELECT count(*) AS n, corr(unity, rate) AS p, corr(ru, rr) AS sp FROM k)
SELECT n, round(p, 6) AS pearson, round(sp, 6) AS spearman, round(tanh(atanh(p) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(p) + 1.959963984540054 / sqrt(n - 3)), 6) AS high FROM s""")
register("labeling_agreement", on(lambda t: stats.adjusted_rand(t.members, "party", "chamber"), "ari", "nmi"), with_views("members") + """
, c AS (SELECT party, chamber, count(*) AS n FROM members GROUP BY 1, 2), r AS (SELECT sum(n) AS n FROM c GROUP BY party), k AS (SELECT sum(n) AS n FROM c GROUP BY chamber),
x AS (SELECT (SELECT sum(n) FROM c) AS t, (SELECT sum(n * (n - 1) / 2) FROM c) AS i, (SELECT sum(n * (n - 1) / 2) FROM r) AS r, (SELECT sum(n * (n - 1) / 2) FROM k) AS k, (SELECT sum(n * ln(n)) FROM c) AS hj, (SELECT sum(n * ln(n)) FROM r) AS hr, (SELECT sum(n * ln(n)) FROM k) AS hc)
SELECT CAST(t AS BIGINT) AS n, round((i - r * k / (t * (t - 1) / 2)) / ((r + k) / 2 - r * k / (t * (t - 1) / 2)), 6) AS ari, round(2 * (ln(t) + (hj - hr - hc) / t) / (2 * ln(t) - (hr + hc) / t), 6) AS nmi FROM x""")
PRIOR = UNITY + """,
m AS (SELECT party, avg(unity) AS mean, var_samp(unity) AS var FROM united GROUP BY party),
prior AS (SELECT party, greatest(mean * (mean * (1 - mean) / var - 1), 0.5) AS alpha, greatest((1 - mean) * (mean * (1 - mean) / var - 1), 0.5) AS beta FROM m)"""
register("beta_prior", on(lambda t: stats.beta_prior(cohesion.unity(t.votes, t.members).withColumn("hits", F.col("party_votes") - F.col("defections")), "hits", "party_votes", "party"), "alpha", "beta"), with_views(*VM, more=PRIOR) + "SELECT party, round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM prior")
register("shrunken_loyalty", on(lambda t: stats.shrunken(cohesion.unity(t.votes, t.members).withColumn("hits", F.col("party_votes") - F.col("defections")).select("voter", "party", "hits", "party_votes"), "hits", "party_votes", "party").drop("alpha", "beta"), "raw", "posterior", "variance", "shrinkage"), with_views(*VM, more=PRIOR) + """
, p AS (SELECT party, voter, party_votes - defections AS hits, party_votes, alpha + party_votes - defections AS a, beta + defections AS b, alpha + beta AS s FROM united JOIN prior USING (party) WHERE party_votes >= 3)
SELECT party, voter, hits, party_votes, round(hits / CAST(party_votes AS DOUBLE), 6) AS raw, round(a / (a + b), 6) AS posterior, round(a * b / ((a + b) * (a + b) * (a + b + 1)), 6) AS variance, round(s / (s + party_votes), 6) AS shrinkage FROM p""")
register("overdispersion", on(lambda t: stats.tarone(cohesion.unity(t.votes, t.members), "defections", "party_votes", "party"), "z", "p"))
register("unity_percentiles", on(lambda t: ranks.percentiles(cohesion.unity(t.votes, t.members).select("voter", "party", F.round("unity", 9).alias("unity")), "unity", "voter", ["party"]), "unity", "percentile"), with_views(*VM, more=UNITY) + """
, u AS (SELECT voter, party, round(unity, 9) AS unity FROM united) SELECT voter, party, round(unity, 6) AS unity, CAST(row_number() OVER (PARTITION BY party ORDER BY unity DESC, voter) AS INTEGER) AS rank,
round(row_number() OVER (PARTITION BY party ORDER BY unity, voter) / CAST(count(*) OVER (PARTITION BY party) AS DOUBLE), 6) AS percentile FROM u""")
register("unity_distribution_distance", on(lambda t: stats.kolmogorov(cohesion.unity(t.votes, t.members).withColumn("unity", F.round("unity", 9)), "unity", "party", *cohesion.PARTIES), "ks"), with_views(*VM, more=UNITY) + """
, g AS (SELECT round(unity, 9) AS u, count(*) FILTER (WHERE party = 'Republican') AS x, count(*) FILTER (WHERE party = 'Democrat') AS y FROM united GROUP BY 1)
SELECT round(max(gap), 6) AS ks FROM (SELECT abs(sum(x) OVER (ORDER BY u) / CAST(sum(x) OVER () AS DOUBLE) - sum(y) OVER (ORDER BY u) / CAST(sum(y) OVER () AS DOUBLE)) AS gap FROM g)""")

# ---------------------------------------------------------------- graphs

register("kappa_edges", on(_graph, "weight"), with_views("votes", more=GRAPH) + "SELECT a, b, round(weight, 6) AS weight FROM edges")
register("degrees", on(lambda t: graph.degrees(_graph(t)), "strength"), with_views("votes", more=GRAPH) + "SELECT voter, degree, round(strength, 6) AS strength FROM degrees")
TRI = """, w AS (SELECT x.a AS p, x.b AS q, z.b AS r FROM edges x JOIN edges z ON x.b = z.a JOIN edges e ON e.a = x.a AND e.b = z.b), tri AS (SELECT voter, count(*) AS triangles FROM (SELECT p AS voter FROM w UNION ALL SELECT q FROM w UNION ALL SELECT r FROM w) GROUP BY voter),
local AS (SELECT voter, degree, coalesce(triangles, 0) AS triangles, coalesce(2 * coalesce(triangles, 0) / nullif(CAST(degree * (degree - 1) AS DOUBLE), 0), 0.0) AS clustering FROM degrees LEFT JOIN tri USING (voter))"""
register("local_clustering", on(lambda t: graph.local_clustering(_graph(t)), "clustering"), with_views("votes", more=GRAPH) + TRI + " SELECT voter, degree, triangles, round(clustering, 6) AS clustering FROM local")
register("network_summary", on(lambda t: graph.summary(_graph(t), t.members), "mean_clustering", "transitivity", "mean_weight", "same_party", "density"), with_views(*VM, more=GRAPH) + TRI + """
, l AS (SELECT count(*) AS nodes, avg(clustering) AS mean_clustering, sum(triangles) / sum(degree * (degree - 1) / 2.0) AS transitivity FROM local), e AS (SELECT count(*) AS edges, avg(weight) AS mean_weight, avg(CASE WHEN x.party = z.party THEN 1 ELSE 0 END) AS same_party FROM edges JOIN members x ON x.voter = a JOIN members z ON z.voter = b)
SELECT nodes, round(mean_clustering, 6) AS mean_clustering, round(CAST(transitivity AS DOUBLE), 6) AS transitivity, edges, round(mean_weight, 6) AS mean_weight, round(same_party, 6) AS same_party, round(2 * edges / CAST(nodes * (nodes - 1) AS DOUBLE), 6) AS density FROM l, e""")
register("party_modularity", on(lambda t: graph.modularity(_graph(t), t.members), "modularity"), with_views(*VM, more=GRAPH) + """
, p AS (SELECT x.party AS pa, z.party AS pb, weight FROM ends JOIN members x ON x.voter = a JOIN members z ON z.voter = b), t AS (SELECT sum(weight) AS m2 FROM p), g AS (SELECT pa, sum(weight) AS tot, sum(CASE WHEN pa = pb THEN weight ELSE 0 END) AS ins FROM p GROUP BY pa)
SELECT round(sum(ins / m2 - (tot / m2) * (tot / m2)), 6) AS modularity, count(*) AS groups FROM g, t""")
register("cross_party_ties", on(lambda t: graph.cross_party(_graph(t), t.members), "share"), with_views(*VM, more=GRAPH) + "SELECT ends.a AS voter, count(*) AS edges, count(*) FILTER (WHERE x.party <> z.party) AS crossing, round(count(*) FILTER (WHERE x.party <> z.party) / CAST(count(*) AS DOUBLE), 6) AS share FROM ends JOIN members x ON x.voter = a JOIN members z ON z.voter = b GROUP BY 1")
register("disparity_backbone", on(lambda t: graph.disparity(_graph(t), 0.3), "weight", "chance"), with_views("votes", more=GRAPH) + """
, r AS (SELECT e.a, e.b, weight, least(CASE WHEN x.degree = 1 THEN 0.0 ELSE pow(1 - weight / x.strength, x.degree - 1) END, CASE WHEN z.degree = 1 THEN 0.0 ELSE pow(1 - weight / z.strength, z.degree - 1) END) AS chance FROM edges e JOIN degrees x ON x.voter = a JOIN degrees z ON z.voter = b)
SELECT a, b, round(weight, 6) AS weight, round(chance, 6) AS chance FROM r WHERE chance < 0.3""")
register("threshold_sweep", on(lambda t: graph.threshold_sweep(_pairs(t), [0.0, 0.02, 0.05, 0.1]), "mean_kappa"), with_views("votes", more=PAIRS) + """
, k AS (SELECT t AS threshold, a, b, kappa FROM pairs, (VALUES (CAST(0.0 AS DOUBLE)), (0.02), (0.05), (0.1)) v(t) WHERE kappa > t), n AS (SELECT threshold, count(DISTINCT voter) AS nodes FROM (SELECT threshold, a AS voter FROM k UNION ALL SELECT threshold, b FROM k) GROUP BY 1)
SELECT threshold, count(*) AS edges, round(avg(kappa), 6) AS mean_kappa, nodes FROM k JOIN n USING (threshold) GROUP BY 1, 4""")
register("item_projection", on(lambda t: graph.projection(agreement.encode(t.votes), 0.0).select("a", "b", "weight", "voters"), "weight"), with_views("votes") + """
, yea AS (SELECT voter, item, count(*) OVER (PARTITION BY voter) AS k FROM votes WHERE choice = 'Yea') SELECT x.item AS a, z.item AS b, round(sum(1.0 / (x.k - 1)), 6) AS weight, count(*) AS voters FROM yea x JOIN yea z ON x.voter = z.voter AND x.item < z.item WHERE x.k > 1 GROUP BY 1, 2""")
register("backbone_comparison", on(lambda t: _compared(_pairs(t)), "jaccard"), with_views("votes", more=GRAPH) + """
, r AS (SELECT e.a, e.b, least(CASE WHEN x.degree = 1 THEN 0.0 ELSE pow(1 - weight / x.strength, x.degree - 1) END, CASE WHEN z.degree = 1 THEN 0.0 ELSE pow(1 - weight / z.strength, z.degree - 1) END) AS chance FROM edges e JOIN degrees x ON x.voter = a JOIN degrees z ON z.voter = b),
f AS (SELECT x.a IS NOT NULL AS p, z.a IS NOT NULL AS q FROM (SELECT a, b FROM r WHERE chance < 0.3) x FULL JOIN (SELECT a, b FROM edges WHERE weight > 0.1) z ON x.a = z.a AND x.b = z.b)
SELECT count(*) FILTER (WHERE p AND q) AS shared, count(*) FILTER (WHERE NOT q) AS first_only, count(*) FILTER (WHERE NOT p) AS second_only, round(count(*) FILTER (WHERE p AND q) / nullif(CAST(count(*) AS DOUBLE), 0), 6) AS jaccard FROM f""")
register("connected_components", on(lambda t: graph.components(graph.edges(_pairs(t), 0.12), _save)), with_views("votes", more=PAIRS).replace("WITH ", "WITH RECURSIVE ", 1) + """
, e AS (SELECT a, b FROM pairs WHERE kappa > 0.12 UNION ALL SELECT b, a FROM pairs WHERE kappa > 0.12), walk(voter, seen) AS (SELECT a, a FROM e UNION SELECT e.b, seen FROM walk JOIN e ON e.a = walk.voter)
SELECT voter, min(seen) AS component FROM walk GROUP BY voter""")
register("pagerank", on(lambda t: graph.pagerank(_graph(t), _save), "rank"))
register("betweenness", on(lambda t: graph.betweenness(_graph(t).join(t.members.select(F.col("voter").alias("a"), F.col("chamber").alias("chamber")), "a").join(t.members.select(F.col("voter").alias("b"), F.col("chamber").alias("other")), "b").where("chamber = other").drop("other")), "betweenness"))


def _save(df: DataFrame) -> DataFrame:
    """Cuts lineage in the folder that the cluster shares."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        sc.setCheckpointDir(base or (tempfile.mkdtemp() if local else df.sparkSession.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"))
    return df.checkpoint()


# ---------------------------------------------------------------- linkage

register("normal_names", on(lambda t: t.members.select("voter", linkage.normal_name(F.concat(F.upper("full_name"), F.lit("  JR. - Majority Leader"))).alias("name"))), with_views("members") + "SELECT voter, lower(full_name) AS name FROM members")
register("staged_match", on(lambda t: linkage.staged(t.members.select("voter", linkage.normal_name(F.col("full_name")).alias("name"), "district"), t.customer.select(F.col("c_custkey").alias("key"), F.lower(F.regexp_replace("c_name", "Customer", "Supplier")).alias("name"), F.col("c_nationkey").alias("district")), [("name", ["name"]), ("district", ["district"])], "voter", "key")), with_views("members") + """
, l AS (SELECT voter, lower(full_name) AS name, district FROM members), r AS (SELECT c_custkey AS key, lower(replace(c_name, 'Customer', 'Supplier')) AS name, c_nationkey AS district FROM customer),
one AS (SELECT voter, key FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM l) x JOIN (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM r) z ON x.name = z.name AND x.n = 1 AND z.n = 1),
l2 AS (SELECT *, count(*) OVER (PARTITION BY district) AS n FROM l WHERE voter NOT IN (SELECT voter FROM one)), r2 AS (SELECT *, count(*) OVER (PARTITION BY district) AS n FROM r WHERE key NOT IN (SELECT key FROM one))
SELECT voter, key, 'name' AS stage FROM one UNION ALL SELECT voter, key, 'district' FROM l2 x JOIN r2 z ON x.district = z.district AND x.n = 1 AND z.n = 1""")
register("positional_pairs", on(lambda t: linkage.positional(t.members.select("district", F.col("full_name").alias("at")), t.customer.select(F.col("c_nationkey").alias("district"), F.col("c_name").alias("at")), ["district"], "at").select("district", F.col("i").cast("int").alias("i"), "left_at", "right_at")), with_views("members") + """
SELECT coalesce(x.district, z.district) AS district, CAST(coalesce(x.i, z.i) AS INTEGER) AS i, left_at, right_at FROM (SELECT district, full_name AS left_at, row_number() OVER (PARTITION BY district ORDER BY full_name) AS i FROM members) x
FULL JOIN (SELECT c_nationkey AS district, c_name AS right_at, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS i FROM customer) z ON x.district = z.district AND x.i = z.i""")
register("keyed_merge", on(lambda t: linkage.merge_keyed(t.orders.where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", "o_orderstatus"), t.orders.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey", F.lit("X").alias("o_orderstatus")), "o_custkey", ["o_custkey", "o_orderkey"])), """
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT DISTINCT o_custkey, o_orderkey, 'X' FROM orders WHERE o_orderstatus = 'P'""")
register("first_wins", on(lambda t: linkage.first_wins(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])), "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1")

# ---------------------------------------------------------------- text

WORDS = "words AS (SELECT doc_id, lang, text, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}]+', ' ', 'g')) AS c FROM documents)"
register("text_lengths", on(lambda t: text.lengths(t.documents), "mean_chars", "median_words"), "WITH " + WORDS + """
SELECT lang, count(*) AS docs, round(avg(length(text)), 6) AS mean_chars, round(median(CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END), 6) AS median_words, CAST(max(CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END) AS INTEGER) AS most_words FROM words GROUP BY lang""")
GRAMS = """grams AS (SELECT {k}, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS g FROM (SELECT {k}, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')), ' ') AS w FROM {t}) WHERE len(w) >= 5)"""
register("ngram_containment", on(lambda t: text.containment(t.documents, t.benchmark), "containment"), "WITH d" + GRAMS.format(k="doc_id", t="documents") + ", m" + GRAMS.format(k="item_id", t="benchmark") + """
, x AS (SELECT doc_id, unnest(g) AS gram FROM dgrams), z AS (SELECT item_id, unnest(g) AS gram FROM mgrams), s AS (SELECT item_id, count(*) AS grams FROM z GROUP BY 1), o AS (SELECT item_id, doc_id, count(*) AS shared FROM x JOIN z USING (gram) GROUP BY 1, 2)
SELECT item_id, doc_id, shared, grams, round(shared / CAST(grams AS DOUBLE), 6) AS containment, CASE WHEN shared / CAST(grams AS DOUBLE) >= 0.7 THEN 'near-identical' WHEN shared / CAST(grams AS DOUBLE) >= 0.4 THEN 'strong' ELSE 'partial' END AS tier FROM o JOIN s USING (item_id) WHERE shared / CAST(grams AS DOUBLE) >= 0.1""")
register("best_version", on(lambda t: text.best_version(t.documents.select("doc_id", "source", "lang", "text"), "source", ["fr", "en"], "lang").select("source", "doc_id", "lang")), "SELECT source, doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 1000000 END, length(text) DESC, doc_id) = 1")
register("top_terms", on(lambda t: text.top_terms(text.term_weights(t.documents), t.documents, "lang"), "weight"), "WITH " + WORDS + """
, tok AS (SELECT doc_id, unnest(string_split(c, ' ')) AS term FROM words WHERE c <> ''), n AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM n GROUP BY term HAVING count(*) >= 3),
w AS (SELECT lang, term, sum(tf * (ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + df AS DOUBLE)) + 1)) AS weight FROM n JOIN df USING (term) JOIN documents USING (doc_id) GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY round(weight, 6) DESC, term) AS INTEGER) AS place FROM w)
SELECT lang, term, round(weight, 6) AS weight, place FROM r WHERE place <= 10""")
register("similar_vectors", on(lambda t: text.similar_within(t.embeddings), "cosine"), """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings)
SELECT p.label, p.vec_id AS a, q.vec_id AS b, round(list_cosine_similarity(p.x, q.x), 6) AS cosine FROM v p JOIN v q ON p.label = q.label AND p.vec_id < q.vec_id WHERE list_cosine_similarity(p.x, q.x) >= 0.3""")
register("centroids", on(lambda t: text.centroids(t.embeddings), "value"), "SELECT label, CAST(place - 1 AS INTEGER) AS place, round(avg(v), 6) AS value FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS place, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1, 2")
register("html_sections", on(lambda t: text.html_sections(t.pages)), """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, CAST(len(string_split(html, '<a ')) - 1 AS INTEGER) AS links, CAST(len(string_split(html, '<p>')) - 1 AS INTEGER) AS paragraphs FROM pages""")
register("event_properties", on(lambda t: t.events.select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), "value").groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.avg("value").alias("mean")), "mean"), "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, round(avg(value), 6) AS mean FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events) GROUP BY 1")

# ---------------------------------------------------------------- prediction

FEATURES = COO + """,
r AS (SELECT voter, item, party, y, (sum(y) OVER (PARTITION BY voter) - y) / nullif(CAST(count(*) OVER (PARTITION BY voter) - 1 AS DOUBLE), 0) AS vr, (sum(y) OVER (PARTITION BY item) - y) / nullif(CAST(count(*) OVER (PARTITION BY item) - 1 AS DOUBLE), 0) AS ir,
    (sum(y) OVER (PARTITION BY item, party) - y) / nullif(CAST(count(*) OVER (PARTITION BY item, party) - 1 AS DOUBLE), 0) AS pr FROM coo JOIN members USING (voter)),
scored AS (SELECT voter, item, party, y, (vr + ir + pr) / 3 AS p FROM r WHERE vr IS NOT NULL AND ir IS NOT NULL AND pr IS NOT NULL)"""


def _scored(t: Tables) -> DataFrame:
    return predict.naive_score(predict.vote_features(agreement.encode(t.votes), t.members, t.items))


register("item_features", on(lambda t: predict.item_features(t.items)), with_views("items") + "SELECT item, bill, substr(bill, 1, 2) AS prefix, item AS number, CAST(day - min(day) OVER (PARTITION BY chamber) AS INTEGER) AS day_of_session, CASE WHEN bill LIKE 'SB%' THEN 1 ELSE 0 END AS is_sb, CASE WHEN bill LIKE 'HB%' THEN 1 ELSE 0 END AS is_hb FROM items")
register("prediction_scores", on(lambda t: predict.scores(_scored(t), "party"), "accuracy", "precision", "recall", "brier", "log_loss", "baseline", "f1"), with_views(*VM, more=FEATURES) + """
, s AS (SELECT party, count(*) AS n, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END) AS accuracy, sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END) / nullif(CAST(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS DOUBLE), 0) AS precision,
sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END) / nullif(CAST(sum(y) AS DOUBLE), 0) AS recall, avg((p - y) * (p - y)) AS brier, avg(-(y * ln(greatest(1e-9, least(1 - 1e-9, p))) + (1 - y) * ln(1 - greatest(1e-9, least(1 - 1e-9, p))))) AS log_loss, greatest(avg(y), 1 - avg(y)) AS baseline FROM scored GROUP BY party)
SELECT party, n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(baseline, 6) AS baseline, round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1 FROM s""")
register("prediction_auc", on(lambda t: predict.auc(_scored(t).withColumn("p", F.round("p", 9))), "auc"), with_views(*VM, more=FEATURES) + """
, g AS (SELECT round(p, 9) AS p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY 1), w AS (SELECT pos, neg, pos * (coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2.0) AS won FROM g)
SELECT round(CAST(sum(won) / (sum(pos) * sum(neg)) AS DOUBLE), 6) AS auc FROM w""")
register("surprising_votes", on(lambda t: predict.surprises(_scored(t)), "error"), with_views(*VM, more=FEATURES) + "SELECT voter, item, party, y, round(round(abs(p - y), 9), 6) AS error FROM scored WHERE (p >= 0.5) <> (y = 1) ORDER BY round(abs(p - y), 9) DESC, voter, item LIMIT 20")
register("hardest_voters", on(lambda t: predict.hardest(_scored(t)), "accuracy"), with_views(*VM, more=FEATURES) + """
, b AS (SELECT voter, party, count(*) AS n, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END) AS accuracy FROM scored GROUP BY 1, 2 HAVING count(*) >= 10 ORDER BY 4, 1 LIMIT 8),
w AS (SELECT voter, item, row_number() OVER (PARTITION BY voter ORDER BY round(abs(p - y), 9) DESC, item) AS i FROM scored WHERE voter IN (SELECT voter FROM b)), l AS (SELECT voter, string_agg(CAST(item AS VARCHAR), ',' ORDER BY i) AS items FROM w WHERE i <= 5 GROUP BY voter)
SELECT voter, party, n, round(accuracy, 6) AS accuracy, items FROM b JOIN l USING (voter)""")

# ---------------------------------------------------------------- latent positions, clusters

register("principal_components", on(lambda t: latent.principal_components(agreement.encode(t.votes), t.members), "score", "explained"))
register("ideal_points", on(lambda t: latent.ideal_points(agreement.encode(t.votes), t.members), "first", "second"))
register("latent_classes", on(lambda t: latent.latent_classes(agreement.encode(t.votes), t.members), "bic", "probability"))
register("vector_clusters", on(lambda t: latent.clusters(t.embeddings)))

# ---------------------------------------------------------------- resources, streams as batch

register("member_search", on(lambda t: api.page(api.find_members(t.members, chamber="House", party="Republican", search="supplier"), ["voter"], 20, 5)), with_views("members") + "SELECT * FROM members WHERE chamber = 'House' AND party = 'Republican' AND lower(full_name) LIKE '%supplier%' ORDER BY voter LIMIT 20 OFFSET 5")
register("item_search", on(lambda t: api.page(api.find_items(t.items, chamber="Senate", date_from="2024-02-01", date_to="2024-12-31", search="sb 1"), ["item"], 50)), with_views("items") + "SELECT * FROM items WHERE chamber = 'Senate' AND day BETWEEN DATE '2024-02-01' AND DATE '2024-12-31' AND (lower(bill) LIKE '%sb 1%' OR lower(motion) LIKE '%sb 1%') ORDER BY item LIMIT 50")
register("item_detail", on(lambda t: api.item_detail(t.items, t.votes, t.members, 42)), with_views("items", *VM) + "SELECT voter, item, bill, motion, i.chamber AS chamber, day, choice, full_name, party FROM items i JOIN votes USING (item) JOIN members m USING (voter) WHERE item = 42")
register("event_windows", on(lambda t: windows.windowed(t.events), "mean"), "SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
register("event_sessions", on(lambda t: windows.sessions(t.events)), """
WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 hours THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 hours AS stop, count(*) AS n FROM s GROUP BY user_id, k""")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by party unity, most loyal first."""
    return QUERIES["unity_maverick"](spark, sf_dir).orderBy(F.desc("unity"), "voter")

# ---------------------------------------------------------------- profiles and model checks

UNIFIED = UNITY + """,
b AS (SELECT voter, avg(CASE WHEN choice = other THEN 1 ELSE 0 END) AS bpi FROM own GROUP BY voter),
wide AS (SELECT m.*, unity, maverick, bpi FROM members m LEFT JOIN united USING (voter) LEFT JOIN b USING (voter))"""


def _wide(t: Tables) -> DataFrame:
    return profiles.unified(t.members, cohesion.unity(t.votes, t.members).select("voter", "unity", "maverick"), cohesion.bipartisanship(t.votes, t.members).select("voter", "bpi"))


register("unified_members", on(_wide, "unity", "maverick", "bpi"), with_views(*VM, more=UNIFIED) + "SELECT voter, full_name, wide.party, chamber, district, round(unity, 6) AS unity, round(maverick, 6) AS maverick, round(bpi, 6) AS bpi FROM wide")
register("scorecard", on(lambda t: profiles.scorecard(_wide(t), ["unity", "bpi"]), "value", "percentile"), with_views(*VM, more=UNIFIED) + """
, l AS (SELECT voter, chamber, 'unity' AS measure, unity AS value FROM wide WHERE unity IS NOT NULL UNION ALL SELECT voter, chamber, 'bpi', bpi FROM wide WHERE bpi IS NOT NULL)
SELECT voter, chamber, measure, round(value, 6) AS value, round(row_number() OVER (PARTITION BY chamber, measure ORDER BY round(value, 9), voter) / CAST(count(*) OVER (PARTITION BY chamber, measure) AS DOUBLE), 6) AS percentile FROM l""")
register("extreme_members", on(lambda t: profiles.extremes(_wide(t), "unity"), "unity"), with_views(*VM, more=UNIFIED) + """
, r AS (SELECT chamber, voter, unity, row_number() OVER (PARTITION BY chamber ORDER BY round(unity, 9) DESC, voter) AS t, row_number() OVER (PARTITION BY chamber ORDER BY round(unity, 9), voter) AS l FROM wide WHERE unity IS NOT NULL)
SELECT chamber, voter, round(unity, 6) AS unity, CASE WHEN t <= 3 THEN 'top' ELSE 'bottom' END AS "end" FROM r WHERE t <= 3 OR l <= 3""")
register("notable_defections", on(lambda t: profiles.notable_defections(t.votes, t.members), "weight"), with_views(*VM, more=SIDES) + """
, d AS (SELECT *, CAST(row_number() OVER (PARTITION BY voter ORDER BY round(weight, 9) DESC, item) AS INTEGER) AS place FROM own WHERE choice <> own) SELECT voter, place, item, choice, round(weight, 6) AS weight FROM d WHERE place <= 3""")
register("running_defections", on(lambda t: profiles.running_defections(t.votes, t.members, t.items)), with_views("items", *VM, more=SIDES) + """
, d AS (SELECT voter, day, count(*) FILTER (WHERE choice <> own) AS x, count(*) AS n FROM own JOIN items USING (item) GROUP BY 1, 2)
SELECT voter, day, CAST(sum(x) OVER w AS BIGINT) AS so_far, CAST(sum(n) OVER w AS BIGINT) AS "of" FROM d WINDOW w AS (PARTITION BY voter ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
register("voting_record", on(lambda t: profiles.record(t.votes, t.members), "contested_rate", "other_rate"), with_views(*VM, more=COO) + """
, s AS (SELECT item, least(avg(y), 1 - avg(y)) >= 0.3 AS contested FROM coo GROUP BY item)
SELECT voter, party, round(avg(y) FILTER (WHERE contested), 6) AS contested_rate, round(avg(y) FILTER (WHERE NOT contested), 6) AS other_rate, count(*) AS n FROM coo JOIN s USING (item) JOIN members USING (voter) GROUP BY 1, 2""")
register("motion_rates", on(lambda t: profiles.motion_rates(t.votes, t.items, t.members, "brand#1"), "with_word", "without"), with_views("items", *VM, more=CAST) + """
, r AS (SELECT party, lower(motion) LIKE '%brand#1%' AS hit, CASE WHEN choice = 'Yea' THEN 1 ELSE 0 END AS y FROM cast_votes JOIN items USING (item) JOIN members USING (voter))
SELECT party, round(avg(y) FILTER (WHERE hit), 6) AS with_word, round(avg(y) FILTER (WHERE NOT hit), 6) AS without, count(*) FILTER (WHERE hit) AS n FROM r GROUP BY party""")
register("party_blocks", on(lambda t: profiles.party_blocks(_pairs(t), t.members), "agreement", "kappa"), with_views(*VM, more=PAIRS) + """
SELECT least(x.party, z.party) AS one, greatest(x.party, z.party) AS other, count(*) AS pairs, round(avg(agreement), 6) AS agreement, round(avg(kappa), 6) AS kappa FROM pairs JOIN members x ON x.voter = a JOIN members z ON z.voter = b GROUP BY 1, 2""")
register("trajectories", on(lambda t: profiles.trajectories(t.sessions), "net", "total", "largest"), with_views("sessions") + """
, s AS (SELECT person, score - lag(score) OVER (PARTITION BY person ORDER BY session) AS step FROM sessions) SELECT person, count(*) AS sessions, round(sum(step), 6) AS net, round(sum(abs(step)), 6) AS total, round(max(abs(step)), 6) AS largest FROM s GROUP BY person""")
register("service_gaps", on(lambda t: profiles.gaps(t.sessions)), with_views("sessions") + """
, s AS (SELECT person, session, lag(session) OVER (PARTITION BY person ORDER BY session) AS before FROM sessions) SELECT person, before AS "left", session AS back, CAST(session - before - 1 AS INTEGER) AS missed FROM s WHERE session - before > 1""")
register("sponsor_lists", on(lambda t: profiles.lists(t.items.select("item", F.concat_ws("; ", "motion", "chamber", F.lit(""), "bill").alias("sponsors")), "item", "sponsors")), with_views("items") + "SELECT item, CAST(p AS INTEGER) AS place, e AS entry FROM (SELECT item, unnest([0, 1, 3]) AS p, unnest([motion, chamber, bill]) AS e FROM items)")
register("residual_correlations", on(lambda t: profiles.residual_correlations(_scored(t)), "q3"), with_views(*VM, more=FEATURES) + """
, e AS (SELECT voter, item, y - p AS e FROM scored), c AS (SELECT x.item AS a, z.item AS b, count(*) AS n, avg(x.e * z.e) - avg(x.e) * avg(z.e) AS cov, avg(x.e * x.e) - avg(x.e) * avg(x.e) AS va, avg(z.e * z.e) - avg(z.e) * avg(z.e) AS vb FROM e x JOIN e z ON x.voter = z.voter AND x.item < z.item GROUP BY 1, 2)
SELECT a, b, n, round(cov / sqrt(va * vb), 6) AS q3, abs(cov / sqrt(va * vb)) > 0.2 AS flag FROM c WHERE n >= 3 AND va > 1e-12 AND vb > 1e-12""")
register("log_likelihood", on(lambda t: profiles.log_likelihood(_scored(t)), "log_likelihood", "gmp", "apre"), with_views(*VM, more=FEATURES) + """
, l AS (SELECT party, y, y * ln(greatest(1e-9, least(1 - 1e-9, p))) + (1 - y) * ln(1 - greatest(1e-9, least(1 - 1e-9, p))) AS ll, CASE WHEN (p >= 0.5) <> (y = 1) THEN 1 ELSE 0 END AS wrong FROM scored)
SELECT party, round(sum(ll), 6) AS log_likelihood, round(exp(avg(ll)), 6) AS gmp, CAST(sum(wrong) AS BIGINT) AS errors, CAST(least(sum(y), sum(1 - y)) AS BIGINT) AS baseline_errors, round(1 - sum(wrong) / CAST(least(sum(y), sum(1 - y)) AS DOUBLE), 6) AS apre FROM l GROUP BY party""")
register("calibration", on(lambda t: profiles.calibration(_scored(t)), "predicted", "observed"), with_views(*VM, more=FEATURES) + "SELECT CAST(least(floor(round(p, 9) * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM scored GROUP BY 1")

# ---------------------------------------------------------------- topics

TOPICS = "topics AS (SELECT p_partkey AS item, p_type AS topic FROM part)"
RATES = COO + ", " + TOPICS + """,
rates AS (SELECT voter, topic, avg(y) AS rate, count(*) AS n FROM coo JOIN topics USING (item) GROUP BY 1, 2 HAVING count(*) >= 5)"""


def _topics(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("item"), F.col("p_type").alias("topic"))


def _rates(t: Tables) -> DataFrame:
    return topics.rates(agreement.encode(t.votes), _topics(t))


register("eligible_topics", on(lambda t: topics.eligible(_topics(t), t.votes)), with_views("votes", more=TOPICS) + """
SELECT topic, count(DISTINCT t.item) AS items, count(DISTINCT v.item) AS with_votes FROM topics t LEFT JOIN (SELECT DISTINCT item FROM votes) v ON v.item = t.item GROUP BY topic HAVING count(DISTINCT v.item) >= 10""")
register("topic_cohesion", on(lambda t: topics.cohesion_by_topic(_riced(t), _topics(t)), "rice", "split"), with_views(*VM, more=RICED + ", " + TOPICS) + "SELECT topic, party, round(avg(rice), 6) AS rice, count(*) AS items, round(1 - avg(rice), 6) AS split FROM riced JOIN topics USING (item) WHERE rice IS NOT NULL GROUP BY 1, 2")
register("topic_passage", on(lambda t: topics.passage(t.votes, _topics(t)), "passed"), with_views("votes", more=TOPICS) + """
, t AS (SELECT item, count(*) FILTER (WHERE choice = 'Yea') AS yea, count(*) FILTER (WHERE choice = 'Nay') AS nay FROM votes GROUP BY item) SELECT topic, count(*) AS items, round(avg(CASE WHEN yea > nay THEN 1 ELSE 0 END), 6) AS passed FROM t JOIN topics USING (item) WHERE yea + nay > 0 GROUP BY topic""")
register("topic_rates", on(_rates, "rate"), with_views("votes", more=RATES) + "SELECT voter, topic, round(rate, 6) AS rate, n FROM rates")
register("topic_correlations", on(lambda t: topics.topic_correlations(_rates(t)), "r"), with_views("votes", more=RATES) + "SELECT x.topic AS one, z.topic AS two, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(x.rate, z.rate) END, 6) AS r FROM rates x JOIN rates z ON x.voter = z.voter AND x.topic < z.topic GROUP BY 1, 2")
register("topic_outliers", on(lambda t: topics.topic_outliers(_rates(t), agreement.encode(t.votes)), "gap"), with_views("votes", more=RATES) + """
, o AS (SELECT voter, avg(y) AS overall FROM coo GROUP BY voter), g AS (SELECT topic, voter, (rate - avg(rate) OVER w) / nullif(stddev_pop(rate) OVER w, 0) - (overall - avg(overall) OVER w) / nullif(stddev_pop(overall) OVER w, 0) AS gap FROM rates JOIN o USING (voter) WINDOW w AS (PARTITION BY topic)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY round(abs(gap), 9) DESC, voter) AS INTEGER) AS place FROM g WHERE gap IS NOT NULL) SELECT topic, place, voter, round(gap, 6) AS gap FROM r WHERE place <= 10""")
register("vote_vectors", on(lambda t: topics.vote_vectors(t.votes, t.embeddings.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))), "value"), with_views("votes") + """
, r AS (SELECT voter, CASE WHEN choice = 'Yea' THEN 1.0 ELSE -1.0 END AS s, embedding, count(*) OVER (PARTITION BY voter) AS n FROM votes JOIN embeddings ON vec_id = item WHERE choice IN ('Yea', 'Nay')),
e AS (SELECT voter, s, unnest(range(0, len(embedding))) AS place, CAST(unnest(embedding) AS DOUBLE) AS v FROM r WHERE n >= 20) SELECT voter, CAST(place AS INTEGER) AS place, round(avg(CAST(s AS DOUBLE) * v), 6) AS value FROM e GROUP BY 1, 2""")
register("windowed_positions", on(lambda t: topics.windowed_positions(agreement.encode(t.votes), t.members, t.items, least=8), "score"))

from . import more  # noqa: E402, F401  registers the queries that build on these
from . import fitted  # noqa: E402, F401
from . import studies  # noqa: E402, F401
from . import linked  # noqa: E402, F401
from . import carried  # noqa: E402, F401
