"""Chambers that are dealt over tasks by items get the results of those that are one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.operators import latent, structure, sweeps

QUERIES = {
    "components": lambda c, m: latent.principal_components(c, m, 3),
    "classes": lambda c, m: latent.latent_classes(c, m, 3, 15),
    "loadings": lambda c, m: structure.loadings(c, m, 2),
    "reconstruction": lambda c, m: structure.reconstruction(c, m, 3, 1.0),
}


@pytest.fixture(scope="module")
def votes(spark):
    rng = np.random.default_rng(8)
    voters, items = [f"v{i:02d}" for i in range(45)], range(90)
    bloc, side = rng.integers(0, 3, 45), rng.integers(0, 3, (3, 90))
    rows = [(v, int(j), int(rng.random() < (0.9 if side[bloc[i], j] else 0.15 + 0.005 * i))) for i, v in enumerate(voters) for j in items if rng.random() < 0.4 and i != 7 and (j + i) % 9]
    # a voter and an item whose cells are unknown, an item of one outcome
    rows += [("v07", 3, None), ("v01", 500, None), *((v, 501, 1) for v in voters[:20] if v != "v07")]
    members = [(v, "House" if i % 3 else "Senate", "Republican" if bloc[i] else "Democrat") for i, v in enumerate(voters)]
    return spark.createDataFrame(rows, "voter string, item long, y int"), spark.createDataFrame(members, "voter string, chamber string, party string")


@pytest.mark.parametrize("name", QUERIES)
def test_dealt_chambers_match_chambers_in_one_task(monkeypatch, votes, name):
    def found():
        out = QUERIES[name](*votes).toPandas()
        keys = [c for c in ("chamber", "item", "voter", "component") if c in out]
        return out.sort_values(keys).reset_index(drop=True)

    want = found()
    monkeypatch.setattr(sweeps, "DIRECT", 0)
    monkeypatch.setattr(sweeps, "BLOCK", 100)
    monkeypatch.setattr(sweeps.Dealt, "sums", (lambda f: lambda self, *a: calls.append(1) or f(self, *a))(sweeps.Dealt.sums))
    calls = []
    got = found()
    assert calls and list(got.columns) == list(want.columns) and len(got) == len(want) > 20
    for c in want.columns:
        if want[c].dtype == float:
            assert np.allclose(got[c], want[c], rtol=1e-6, atol=1e-6), c
        else:
            assert (got[c] == want[c]).all(), c


def test_cells_are_held_out_over_tasks(monkeypatch, spark, votes):
    coo, members = votes
    known = {r["chamber"]: r["n"] for r in coo.where("y is not null").join(members, "voter").groupBy("chamber").agg(F.count("*").alias("n")).collect()}
    want = {r["chamber"]: r for r in structure.component_holdout(coo, members, 3).collect()}
    monkeypatch.setattr(sweeps, "DIRECT", 0)
    held = {r["chamber"]: r for r in structure.component_holdout(coo, members, 3).collect()}
    assert set(held) == set(known) == {"House", "Senate"}
    cells = structure.drawn(latent.with_group(coo, members), 0.2, 42).toPandas()
    for c, r in held.items():
        assert r["n"] == want[c]["n"] == int(known[c] * 0.2) and type(r["n"]) is int
        # the same masked cells by hand
        mine = cells[cells["chamber"] == c]
        voters, items = sorted(set(mine["voter"])), sorted(set(mine["item"]))
        x, test = np.full((len(voters), len(items)), np.nan), []
        for cell in mine.itertuples():
            at = voters.index(cell.voter), items.index(cell.item)
            if cell.held:
                test.append((*at, cell.y))
            else:
                x[at] = cell.y
        z, centre, scale = structure._standard(structure._filled(x))
        u, s, v = np.linalg.svd(z, full_matrices=False)
        guess = np.array([(u[i, :3] * s[:3]) @ v[:3, j] * scale[j] + centre[j] for i, j, _ in test])
        truth = np.array([y for *_, y in test])
        told = ((guess >= 0.5) == (truth == 1)).mean(), structure._auc(truth, np.clip(guess, 0, 1)), np.sqrt(((guess - truth) ** 2).mean()), max(truth.mean(), 1 - truth.mean())
        assert np.allclose([r["accuracy"], r["auc"], r["rmse"], r["baseline"]], told)


def test_the_solver_restarts_and_takes_equal_eigenvalues(monkeypatch):
    monkeypatch.setattr(sweeps, "MOST", 24)
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    e = np.r_[9.0, 5.0, 5.0, 5.0, np.linspace(4.9, 0, 296)]
    matrix, solver = (q * e) @ q.T, sweeps.greatest(300, 3)
    asked = next(solver)
    with pytest.raises(StopIteration) as end:
        while True:
            asked = solver.send(matrix @ asked)
    values, vectors = end.value.value
    assert np.allclose(values, e[:3], atol=1e-9) and np.allclose(matrix @ vectors, vectors * values, atol=1e-6)
