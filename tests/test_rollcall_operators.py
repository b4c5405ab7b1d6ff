"""Hand cases and invariants of the roll-call operators, sources and streams."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.operators import agreement, align, cohesion, graph, integrity, latent, lifecycle, linkage, predict, stats, timeseries
from quorate.sources import files
from quorate.streaming import windows

VOTES = "item long, voter string, choice string"
MEMBERS = "voter string, full_name string, party string, chamber string, district int"


def roster(spark, r, d):
    rows = [(f"r{i}", f"R {i}", "Republican", "House", i) for i in range(r)] + [(f"d{i}", f"D {i}", "Democrat", "House", 100 + i) for i in range(d)]
    return spark.createDataFrame(rows, MEMBERS)


@pytest.fixture(scope="module")
def small_house(spark):
    """5 R and 3 D: item 1 splits the parties with one R defector, item 2 with one D, item 3 is unanimous."""
    votes = [(1, f"r{i}", "Nay" if i == 4 else "Yea") for i in range(5)] + [(1, f"d{i}", "Nay") for i in range(3)]
    votes += [(2, f"r{i}", "Yea") for i in range(5)] + [(2, "d0", "Nay"), (2, "d1", "Nay"), (2, "d2", "Yea")]
    votes += [(3, v, "Yea") for v in [*(f"r{i}" for i in range(5)), *(f"d{i}" for i in range(3))]]
    return spark.createDataFrame(votes, VOTES), roster(spark, 5, 3)


def test_party_votes_and_unity(small_house):
    votes, members = small_house
    lines = {r.item: r.party_vote for r in cohesion.party_votes(cohesion.party_counts(votes, members)).collect()}
    assert lines == {1: True, 2: True, 3: False}
    united = {r.voter: r for r in cohesion.unity(votes, members).collect()}
    assert united["r4"].defections == 1 and united["d2"].defections == 1 and united["r0"].defections == 0
    assert all(abs(r.unity + r.maverick - 1) < 1e-12 for r in united.values())


def test_rice_by_counts(spark):
    counts = spark.createDataFrame([(1, "R", 7, 3, 10), (2, "R", 4, 0, 4), (3, "R", 5, 5, 10), (4, "R", 75, 25, 100), (5, "R", 1, 0, 1)], "item int, party string, yea long, nay long, voters long")
    got = {r.item: r.rice for r in cohesion.rice(counts, 2).collect()}
    assert got == {1: 0.4, 2: 1.0, 3: 0.0, 4: 0.5, 5: None}


def test_carey_is_at_most_rice(small_house):
    votes, members = small_house
    counts = cohesion.party_counts(votes, members)
    both = cohesion.carey(votes, members).join(cohesion.rice(counts).select("item", "party", "rice"), ["item", "party"])
    assert all(r.carey <= r.rice + 1e-12 for r in both.collect())


def test_kappa_of_twins_and_opposites(spark):
    rows = [("a", i, i % 2) for i in range(10)] + [("b", i, i % 2) for i in range(10)] + [("c", i, 1 - i % 2) for i in range(10)] + [("e", i, 1) for i in range(5)]
    got = {(r.a, r.b): (r.agreement, r.kappa) for r in agreement.pairs(spark.createDataFrame(rows, "voter string, item long, y int")).collect()}
    assert got == {("a", "b"): (1.0, 1.0), ("a", "c"): (0.0, -1.0), ("b", "c"): (0.0, -1.0)}


def test_transitions(spark):
    def run(*steps):
        t0 = datetime.datetime(2024, 1, 1)
        frame = spark.createDataFrame([("b", t0 + datetime.timedelta(days=i), s, i) for i, s in enumerate(steps)], "bill string, ts timestamp, status string, event_id long")
        return {(r.source, r.target): r.n for r in lifecycle.transitions(frame).collect()}

    assert run("Introduced", "Referred to Committee") == {("Introduced", "Committee Referral"): 1, ("Committee Referral", "Died"): 1}
    assert run("Referred to Committee on X", "Referred to committee on Y", "Hearing") == {("Committee Referral", "Hearing"): 1, ("Hearing", "Died"): 1}
    assert run("Introduced", "Approved by Governor") == {("Introduced", "Signed into Law"): 1}
    assert run("Emergency Final Action", "Line item veto") == {("Floor Vote", "Vetoed"): 1}


def test_outcomes_and_names(spark):
    texts = spark.createDataFrame([("not passed",), ("Veto sustained",), ("Passed as amended",), ("",), ("Amendment rejected",), ("Bypassed",)], "t string")
    assert [r[0] for r in texts.select(lifecycle.outcome(F.col("t"))).collect()] == [False, False, True, None, False, None]
    names = spark.createDataFrame([("Bob Jones - House Minority Caucus Chair",), ("  Jane Doe  ",), ("Doe, Jane A.",)], "n string")
    assert [r[0] for r in names.select(linkage.normal_name(F.col("n"))).collect()] == ["bob jones", "jane doe", "jane a doe"]
    bills = spark.createDataFrame([("Sub for HB 2007",), ("S Sub for Sub for HB 2007",), ("  SB   55  ",), ("s sub FOR HB 7",)], "b string")
    assert [r[0] for r in bills.select(linkage.normal_bill(F.col("b"))).collect()] == ["HB 2007", "HB 2007", "SB 55", "HB 7"]


def test_turnover(spark):
    rows = [(i, 1, 0.0) for i in range(30)] + [(i, 2, 0.0) for i in range(5, 35)]
    got = {r.session: (r.stayed, r.left, r.came) for r in align.turnover(spark.createDataFrame(rows, "person int, session int, score double")).collect()}
    assert got[1] == (25, 5, 5)


def test_link_recovers_a_line(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=100)
    rows = [(i, 1, float(v)) for i, v in enumerate(x)] + [(i, 2, float(3 * v + 1 if i else 500.0)) for i, v in enumerate(x)]
    r = align.links(align.bridges(spark.createDataFrame(rows, "person int, session int, score double"))).first()
    assert abs(r.slope - 3) < 1e-6 and abs(r.intercept - 1) < 1e-6 and r.used == 90
    few = align.links(align.bridges(spark.createDataFrame(rows[:10] + rows[100:110], "person int, session int, score double"))).first()
    assert (few.slope, few.intercept) == (1.0, 0.0)


def test_components_and_clustering(spark):
    g = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("x", "y", 1.0)], "a string, b string, weight double")
    got = {r.voter: r.component for r in graph.components(g, lambda d: d.cache()).collect()}
    assert got == dict.fromkeys("abcd", "a") | dict.fromkeys("xy", "x")
    local = {r.voter: (r.triangles, round(r.clustering, 6)) for r in graph.local_clustering(g).collect()}
    assert local["a"] == (1, 1.0) and local["c"] == (1, 0.333333) and local["x"] == (0, 0.0)
    ranks = {r.voter: r.rank for r in graph.pagerank(g, lambda d: d, 4).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["c"] == max(ranks.values())


def test_betweenness_of_a_path(spark):
    g = spark.createDataFrame([("House", "a", "b", 1.0), ("House", "b", "c", 1.0)], "chamber string, a string, b string, weight double")
    assert {r.voter: r.betweenness for r in graph.betweenness(g).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}


def test_latent_positions_separate_the_parties(spark):
    rng = np.random.default_rng(4)
    members = roster(spark, 12, 12)
    rows = []
    for i in range(60):
        for p, chance in (("r", 0.85), ("d", 0.15)):
            rows += [(f"{p}{k}", i, int(rng.random() < (chance if i % 2 else 1 - chance))) for k in range(12)]
    coo = spark.createDataFrame(rows, "voter string, item long, y int")
    points = {r.key: r.first for r in latent.ideal_points(coo, members).where("kind = 'voter'").collect()}
    assert min(v for k, v in points.items() if k[0] == "r") > max(v for k, v in points.items() if k[0] == "d")
    scores = {r.voter: r.score for r in latent.principal_components(coo, members).where("component = 1").collect()}
    assert min(v for k, v in scores.items() if k[0] == "r") > max(v for k, v in scores.items() if k[0] == "d")
    groups = {(r.voter[0], r["class"]) for r in latent.latent_classes(coo, members, most=2).collect()}
    assert len(groups) == 2


def test_pelt_finds_a_step():
    x = np.r_[np.zeros(40), np.ones(40) * 5] + np.random.default_rng(0).normal(size=80) * 0.1
    assert timeseries.pelt(x, 3.0) == [40, 80]


def test_prior_of_loyal_members(spark):
    rng = np.random.default_rng(1)
    rows = [(f"v{i}", "R", int(rng.binomial(100, 0.9)), 100) for i in range(10)]
    r = stats.beta_prior(spark.createDataFrame(rows, "voter string, party string, hits int, n int"), "hits", "n", "party").first()
    assert 0.85 < r.alpha / (r.alpha + r.beta) < 0.95 and r.alpha > r.beta


def test_perfect_prediction_scores(spark):
    frame = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), ("a", 1, 0.8), ("a", 0, 0.2)], "party string, y int, p double")
    r = predict.scores(frame, "party").first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (1.0, 1.0, 1.0, 1.0)
    assert predict.auc(frame).first().auc == 1.0


def test_near_duplicate_items(spark):
    rows = [(1, f"v{i}", "Yea" if i < 6 else "Nay") for i in range(12)] + [(2, f"v{i}", "Yea" if i < 7 else "Nay") for i in range(12)] + [(3, f"v{i}", "Yea" if i % 2 else "Nay") for i in range(12)]
    got = integrity.near_duplicate_items(spark.createDataFrame(rows, VOTES)).collect()
    assert [(r.a, r.b, r.common, r.differ) for r in got] == [(1, 2, 12, 1)]


def test_files_round_trip(spark, tmp_path):
    members = roster(spark, 3, 2).withColumn("tags", F.array(F.lit("x"))).withColumn("blank", F.lit(" "))
    files.write_csv(members, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"), MEMBERS + ", blank string")
    assert back.count() == 5 and "tags" not in files.flat(members).columns
    assert "blank" not in files.drop_empty(members, ["blank", "none"]).columns
    assert files.read_optional(spark, str(tmp_path / "nothing")) is None
    assert files.ensure_columns(members, {"extra": "int"}).schema["extra"].dataType.typeName() == "integer"
    assert files.first_with_rows(None, members.where("false"), members).count() == 5
    for _ in range(2):
        files.replace_label(members.select("voter", "party"), str(tmp_path / "by"), "party")
    assert spark.read.parquet(str(tmp_path / "by")).count() == 5


def test_streams_equal_batches(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = windows.windowed(windows.read_events(spark, str(tmp_path / "events")), late="365 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((str(r.start), r.event_type, r.n, round(r["mean"], 6)) for r in spark.sql("select * from windowed").collect())
    want = sorted((str(r.start), r.event_type, r.n, round(r["mean"], 6)) for r in windows.windowed(events).collect())
    assert got == want
    once = windows.once(windows.read_events(spark, str(tmp_path / "events")), "365 days").writeStream.format("memory").queryName("once").start()
    once.processAllAvailable()
    once.stop()
    assert spark.sql("select * from once").count() == events.dropDuplicates(["event_id"]).count()
