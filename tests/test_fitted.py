"""Fitted models and structure: planted signal, plain versions, exact expectations, odd inputs."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from quorate.operators import models, predict, structure


def votes_of(table, chamber="House"):
    """(coo rows, member rows) of a voter x item array with NaN for a missing vote; the first half are Republicans."""
    n = len(table)
    coo = [(f"v{i:03d}", j, int(table[i, j])) for i in range(n) for j in range(table.shape[1]) if not np.isnan(table[i, j])]
    members = [(f"v{i:03d}", "Republican" if i < n // 2 else "Democrat", chamber) for i in range(n)]
    return coo, members


@pytest.fixture(scope="module")
def planted():
    """Two blocs that differ on every item, with 10 % noise and 10 % gaps."""
    rng = np.random.default_rng(1)
    side = np.repeat([1, 0], 12)[:, None] == rng.integers(0, 2, 60)
    table = np.where(rng.random(side.shape) < 0.1, ~side, side).astype(float)
    table[rng.random(table.shape) < 0.1] = np.nan
    return table


@pytest.fixture(scope="module")
def frames(spark, planted):
    coo, members = votes_of(planted)
    items = [(j, f"{'SB' if j % 2 else 'HB'} {j}", "m", "House", pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=j // 3)) for j in range(planted.shape[1])]
    return (
        spark.createDataFrame(coo, "voter string, item long, y int"),
        spark.createDataFrame(members, "voter string, party string, chamber string"),
        spark.createDataFrame(items, "item long, bill string, motion string, chamber string, day date"),
    )


# ---------------------------------------------------------------- classifiers


def test_held_rates_leave_the_part_and_held_rows_out(spark):
    rng = np.random.default_rng(2)
    rows = [(f"v{v}", t, "RD"[v % 2], int(rng.integers(2)), bool(rng.random() < 0.2)) for v in range(6) for t in range(9) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "voter string, item long, party string, y int, h boolean")
    got = models.held_rates(df, df["h"], 3).collect()
    assert len(got) == len(rows) and len({r["deal"] for r in got}) == 3

    def rate(r, *keys):
        ys = [o["y"] for o in got if not o["held"] and (r["held"] or o["deal"] != r["deal"]) and all(o[k] == r[k] for k in keys)]
        return sum(ys) / len(ys) if ys else 0.5

    for r in got:
        assert (r["voter_rate"], r["item_rate"], r["party_item_rate"]) == (rate(r, "voter"), rate(r, "item"), rate(r, "item", "party"))


def test_vote_models_find_the_blocs(frames):
    out = models.vote_models(*frames, rounds=5, trees=5).collect()
    assert {(r["model"], r["part"]) for r in out} == set(itertools.product(("logistic regression", "boosted trees", "random forest"), ("held out", *(f"fold {i}" for i in range(1, 6)))))
    for model in {r["model"] for r in out}:
        held = [r for r in out if r["model"] == model and r["part"] == "held out"]
        folds = [r for r in out if r["model"] == model and r["part"] != "held out"]
        for rows in (held, folds):  # one held-out part, and the mean of the folds
            assert np.mean([r["accuracy"] for r in rows]) > 0.8 > max(r["baseline"] for r in rows) and np.mean([r["auc"] for r in rows]) > 0.85
    parts = {r["part"]: r["n"] for r in out}
    assert sum(parts.values()) == frames[0].count()  # every vote is held once


def test_importances_favour_the_party(frames):
    out = {(r["model"], r["feature"]): r["weight"] for r in models.importances(*frames, rounds=5, trees=5).collect()}
    assert max((w, f) for (m, f), w in out.items() if m == "boosted trees")[1] == "party_item_rate"


def test_later_days_are_never_learned_from(frames):
    rows = frames[2].select("item", "day")
    cut = models.early(rows)
    first, later = rows.where(cut), rows.where(~cut)
    assert first.agg({"day": "max"}).first()[0] < later.agg({"day": "min"}).first()[0]
    assert 0.6 < first.count() / rows.count() <= 0.7


@pytest.mark.parametrize("same", [0, 1])
def test_models_of_one_class_or_nothing_are_empty(spark, frames, same):
    coo, members, items = frames
    one = coo.selectExpr("voter", "item", f"{same} AS y") if same else coo.limit(0)
    assert models.vote_models(one, members, items, folds=2, rounds=2, trees=2).isEmpty()
    assert models.held_out_votes(one, members, items, rounds=2).isEmpty()
    assert models.importances(one, members, items, rounds=2, trees=2).isEmpty()


def test_passage_models_of_tallies(frames):
    coo, _, items = frames
    votes = coo.selectExpr("voter", "item", "CASE WHEN item % 2 = 1 THEN 'Yea' ELSE 'Nay' END AS choice")  # senate bills pass
    out = models.passage_models(votes, items, rounds=3, trees=5).collect()
    assert {r["part"] for r in out} == {"held out", "later"} and all(r["accuracy"] == 1 for r in out)


def test_auc_counts_ties_half(spark):
    rng = np.random.default_rng(3)
    rows = [(float(p), int(y)) for p, y in zip(rng.integers(0, 40, 500) / 39, rng.integers(0, 2, 500), strict=True)]
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    for bins in (1, 7, 4096):
        assert math.isclose(predict.auc(spark.createDataFrame(rows, "p double, y int"), bins).first()["auc"], want, abs_tol=1e-12)


# ---------------------------------------------------------------- components


def test_components_of_two_blocs(frames, planted):
    coo, members, _ = frames
    count = structure.component_count(coo, members, draws=20).toPandas().sort_values("component")
    assert list(count["keep"])[:2] == [True, False]
    z = (lambda x: (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1))(np.where(np.isnan(planted), np.nanmean(planted, 1, keepdims=True), planted))
    assert np.allclose(count["eigenvalue"], np.linalg.eigvalsh(z @ z.T)[::-1][:5] / (len(z) - 1))
    first = structure.loadings(coo, members).where("component = 1").toPandas().sort_values("item")["loading"].to_numpy()
    assert math.isclose((first**2).sum(), 1) and np.corrcoef(first, np.nanmean(planted[:12], 0) - np.nanmean(planted[12:], 0))[0, 1] > 0.9
    held = structure.component_holdout(coo, members, k=2).first()
    assert held["n"] == int((~np.isnan(planted)).sum() * 0.2) and held["accuracy"] > 0.8 > held["baseline"] and held["auc"] > 0.85


def test_reconstruction_flags_the_odd_voter(spark, planted):
    odd = planted.copy()
    odd[5] = np.random.default_rng(4).integers(0, 2, 60)
    coo, members = votes_of(odd)
    out = structure.reconstruction(spark.createDataFrame(coo, "voter string, item long, y int"), spark.createDataFrame(members, "voter string, party string, chamber string"), k=1).toPandas()
    assert list(out[out["flag"]]["voter"]) == ["v005"]
    full = structure.reconstruction(spark.createDataFrame(coo, "voter string, item long, y int"), spark.createDataFrame(members, "voter string, party string, chamber string"), k=24).toPandas()
    assert full["rmse"].max() < 1e-9


def test_second_component_folds(spark):
    x = np.linspace(-1, 1, 30)
    rows = [("House", f"v{i:02d}", c, float(s)) for i, p in enumerate(x) for c, s in ((1, p), (2, p * p - 1))]
    out = structure.second_component(spark.createDataFrame(rows, "chamber string, voter string, component int, score double")).first()
    low = min(x**2 - 1)
    assert math.isclose(out["r2"], 1) and out["score"] == pytest.approx(low) and out["extreme"] == (abs(low) > 3 * np.std(x**2 - 1, ddof=1))


def test_correspondence_against_the_burt_table(spark, planted):
    names = np.where(np.isnan(planted), "Absent", np.where(planted == 1, "Yea", "Nay"))[:, :12]
    _, members = votes_of(planted)
    rows = [(f"v{i:03d}", j, names[i, j]) for i in range(len(names)) for j in range(names.shape[1])]
    out = structure.correspondence(spark.createDataFrame(rows, "voter string, item long, cat string"), spark.createDataFrame(members, "voter string, party string, chamber string"), k=3).toPandas()
    z = np.array([names[:, j] == c for j in range(names.shape[1]) for c in np.unique(names[:, j])], float)
    burt, sums = z @ z.T, z.sum(1)
    eigen = np.sort(np.linalg.eigvalsh(burt / np.sqrt(np.outer(sums, sums)) / names.shape[1]))[::-1][1:4]
    inertia = out[out["kind"] == "inertia"].sort_values("dimension")
    assert np.allclose(inertia["coordinate"], eigen)
    voters = out[(out["kind"] == "voter") & (out["dimension"] == 1)].sort_values("key")["coordinate"].to_numpy()
    assert voters[:12].mean() > 0 > voters[12:].mean() and math.isclose((voters**2).mean(), eigen[0])
    assert np.allclose(out[out["kind"] == "category"].groupby("dimension")["share"].sum(), 1)
    assert out[out["kind"] == "voter"].groupby("key")["share"].sum().max() <= 1 + 1e-9


# ---------------------------------------------------------------- clusters


def test_average_linkage_against_plain(planted):
    rng = np.random.default_rng(5)
    x = rng.random((14, 2))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    groups, want = {i: [i] for i in range(14)}, []
    for step in range(13):
        a, b = min(itertools.combinations(groups, 2), key=lambda p: np.mean([d[i, j] for i in groups[p[0]] for j in groups[p[1]]]))
        want.append((min(a, b), max(a, b), np.mean([d[i, j] for i in groups[a] for j in groups[b]])))
        groups[14 + step] = groups.pop(a) + groups.pop(b)
    got = structure.average_linkage(d)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    assert len(np.unique(structure.cut(got, 14, 4))) == 4


def test_silhouette_against_plain():
    rng = np.random.default_rng(6)
    x, labels = rng.random((20, 2)), rng.integers(0, 3, 20)
    labels[0] = 3  # alone
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    want = []
    for i in range(20):
        same = [j for j in range(20) if labels[j] == labels[i] and j != i]
        if not same:
            want.append(0.0)
            continue
        a, b = d[i, same].mean(), min(d[i, labels == g].mean() for g in set(labels) - {labels[i]})
        want.append((b - a) / max(a, b))
    assert math.isclose(structure.silhouette(d, labels), np.mean(want))


def test_member_clusters_find_the_blocs(frames):
    out = structure.member_clusters(*frames[:2]).toPandas()
    for method in ("average linkage", "spectral", "k-means"):
        rows = out[out["method"] == method].sort_values("voter")
        assert set(rows["clusters"]) == {2} and list(rows["cluster"]) == [0] * 12 + [1] * 12, method
    assert out[out["method"] == "mixture"]["clusters"].iloc[0] >= 2


def test_clade_support_of_the_blocs(frames):
    out = structure.clade_support(*frames[:2], replicates=20).toPandas()
    blocs = {",".join(f"v{i:03d}" for i in part) for part in (range(12), range(12, 24))}
    assert set(out[out["voters"].isin(blocs)]["support"]) == {1.0} and len(out) == 23


def test_kappa_distances_match_the_pairs(spark, frames, planted):
    from quorate.operators import agreement

    _, kappa = structure.kappa_distances(planted, 10)
    for r in agreement.pairs(frames[0], 10).collect():
        assert math.isclose(kappa[int(r["a"][1:]), int(r["b"][1:])], r["kappa"], abs_tol=1e-9)


# ---------------------------------------------------------------- communities, null model


def test_louvain_on_two_cliques():
    w = np.zeros((9, 9))
    w[:4, :4] = w[4:, 4:] = 1
    np.fill_diagonal(w, 0)
    w[3, 4] = w[4, 3] = 0.1
    assert list(structure.louvain(w)) == [0] * 4 + [1] * 5
    assert list(structure.louvain(w, 0.5, constant=True)) == [0] * 4 + [1] * 5
    assert len(set(structure.louvain(w, 100.0))) == 9


def test_louvain_near_the_best_partition():
    rng = np.random.default_rng(8)
    for _ in range(5):
        w = np.triu(rng.random((7, 7)) * (rng.random((7, 7)) < 0.5), 1)
        w += w.T
        best = max(structure.partition_quality(w, np.array(p)) for p in itertools.product(range(4), repeat=7))
        assert structure.partition_quality(w, structure.louvain(w)) >= best - 0.05


def test_communities_of_the_blocs(spark):
    edges = [("House", f"v{i}", f"v{j}", 0.9) for i, j in itertools.combinations(range(8), 2) if (i < 4) == (j < 4)]
    out = structure.communities(spark.createDataFrame(edges, "chamber string, a string, b string, weight double"), "chamber", (1.0,)).toPandas().sort_values("voter")
    assert list(out["community"]) == [0] * 4 + [1] * 4 and math.isclose(out["modularity"].iloc[0], 0.5)


def test_path_centralities_of_a_path(spark):
    edges = [("House", "v0", "v1", 1.0), ("House", "v1", "v2", 0.5)]
    out = {r["voter"]: r for r in structure.path_centralities(spark.createDataFrame(edges, "chamber string, a string, b string, weight double"), "chamber").collect()}
    assert math.isclose(out["v0"]["closeness"], 2 / (1 + 3)) and math.isclose(out["v1"]["closeness"], 2 / (1 + 2))
    assert math.isclose(out["v0"]["harmonic"], 1 + 1 / 3) and math.isclose(out["v2"]["harmonic"], 1 / 2 + 1 / 3)
    norm = math.sqrt(1 + 1 + 0.25 + 0.25)  # the eigenvector is (w01, root, w12)
    assert np.allclose([out[v]["eigenvector"] for v in ("v0", "v1", "v2")], np.array([1, math.sqrt(1.25), 0.5]) / norm)


def test_configuration_model_keeps_degrees():
    rng = np.random.default_rng(9)
    y = (rng.random((12, 30)) < rng.random(30)).astype(int)
    y[0], y[:, 0], y[1] = 1, 1, 0
    y[1, 0] = 0
    p = structure.configuration_model(y.sum(1), y.sum(0))
    assert np.allclose(p.sum(1), y.sum(1), atol=1e-5) and np.allclose(p.sum(0), y.sum(0), atol=1e-5) and p.min() >= 0 and p.max() <= 1


def test_poisson_tail_against_the_sum():
    for k, mean in ((0, 2.0), (3, 2.0), (40, 7.5), (5, 60.0)):
        want = 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k))
        assert math.isclose(structure._poisson_tail(np.array([k]), np.array([mean]))[0], want, rel_tol=1e-6, abs_tol=1e-13)


def test_null_backbone_joins_only_the_blocs(frames):
    out = structure.null_backbone(*frames[:2], alpha=0.05).collect()
    assert out and all((int(r["a"][1:]) < 12) == (int(r["b"][1:]) < 12) and r["shared"] > r["expected"] for r in out)


def test_kernels_of_one_voter_and_of_nothing(spark):
    members = spark.createDataFrame([("v0", "Republican", "House")], "voter string, party string, chamber string")
    one = spark.createDataFrame([("v0", 1, 1), ("v0", 2, 0)], "voter string, item long, y int")
    for f in (structure.component_count, structure.loadings, structure.reconstruction, structure.component_holdout, structure.member_clusters, structure.clade_support, structure.null_backbone):
        f(one, members).collect()
        assert f(one.limit(0), members).isEmpty()
