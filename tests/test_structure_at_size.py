"""Kernels of structure hold cells, the square of the voters or degrees, and not the table of voters by items; results as in plain versions."""

import itertools
import tracemalloc

import numpy as np
import pytest

from quorate.operators import structure
from quorate.operators.sparse_votes import Cells

COO, MEMBERS = "voter string, item long, y int", "voter string, party string, chamber string"


@pytest.fixture(scope="module")
def wide():
    """30 voters by two million items, 20,000 cells: 480 MB as a table."""
    rng = np.random.default_rng(1)
    code = np.unique(rng.integers(0, 30 * 2_000_000, 20_000))
    i, j = (code // 2_000_000).astype(np.int32), (code % 2_000_000).astype(np.int32)
    return Cells("House", np.arange(30).astype(str), np.arange(2_000_000), np.full(30, "Democrat", object), i, j, rng.integers(0, 2, len(code)).astype(float))


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(2)
    table = rng.random((20, 90))
    coo = [(f"v{i:02d}", j, int(table[i, j] < 0.4)) for i, j in itertools.product(range(20), range(90)) if table[i, j] < 0.7]
    y = np.full((20, 90), np.nan)
    for v, j, x in coo:
        y[int(v[1:]), j] = x
    members = [(f"v{i:02d}", "Republican" if i < 10 else "Democrat", "House") for i in range(20)]
    return spark.createDataFrame(coo, COO), spark.createDataFrame(members, MEMBERS), y


def peak(f):
    tracemalloc.start()
    f()
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return used / 1e6


def test_distances_of_many_items_hold_no_table(wide):
    assert peak(lambda: structure.cell_distances(wide, 10, np.random.default_rng(3).integers(0, 3, 2_000_000))) < 100


def test_resampled_distances_are_those_of_repeated_items(frames):
    y = frames[2]
    i, j = np.nonzero(~np.isnan(y))
    drawn = np.random.default_rng(4).integers(0, 90, 90)
    got = structure.cell_distances(Cells("House", np.arange(20), np.arange(90), None, i, j, y[i, j]), 10, np.bincount(drawn, minlength=90))
    want = structure.kappa_distances(y[:, drawn], 10)
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1], equal_nan=True)


def test_linkage_breaks_ties_by_the_first_pair():
    rng = np.random.default_rng(5)
    for _ in range(20):
        d = np.triu(rng.integers(1, 4, (12, 12)).astype(float), 1)
        d += d.T
        full, alive, want = np.where(np.eye(12) > 0, np.inf, d), np.ones(12), []
        for _ in range(11):
            i, j = sorted(np.unravel_index(np.argmin(full), full.shape))
            want.append(full[i, j])
            mixed = (alive[i] * full[i] + alive[j] * full[j]) / (alive[i] + alive[j])
            alive[i] += alive[j]
            full[i], full[:, i] = mixed, mixed
            full[j], full[:, j], full[i, i] = np.inf, np.inf, np.inf
        assert [m[2] for m in structure.average_linkage(d)] == want


def test_clade_support_over_several_tasks(frames):
    coo, members, y = frames

    def clades(m):
        of = {i: frozenset([i]) for i in range(20)}
        for step, (a, b, _, _) in enumerate(structure.average_linkage(structure.kappa_distances(m, 10)[0])):
            of[20 + step] = of.pop(a) | of.pop(b)
            yield of[20 + step]

    rng, mine = np.random.default_rng(42), list(clades(y))
    drawn = [set(clades(y[:, rng.integers(0, 90, 90)])) for _ in range(10)]
    want = {",".join(f"v{i:02d}" for i in sorted(c)): sum(c in d for d in drawn) / 10 for c in mine}
    assert structure.RESAMPLES < 10
    assert {r["voters"]: r["support"] for r in structure.clade_support(coo, members, replicates=10).collect()} == want


def test_noise_of_many_columns_holds_no_table():
    assert peak(lambda: structure.noise_squares(60, 1_000_000, np.random.default_rng(6))) < 300  # 480 MB as a table
    flat, tall = (structure.noise_squares(n, q, np.random.default_rng(7)) for n, q in ((12, 40), (40, 12)))
    assert np.isclose(flat.sum(), 12 * 40) and np.isclose(tall.sum(), 12 * 40)  # every column has a square of its rows


def test_degrees_stand_for_nodes():
    rng = np.random.default_rng(8)
    rows, columns = np.array([3, 5, 8]), np.array([0, 1, 2])
    p = structure.degree_model(rows, [40_000] * 3, columns, [100_000, 320_000, 160_000])  # 120,000 rows by 580,000 columns
    assert p.shape == (3, 3) and np.allclose(p @ [100_000, 320_000, 160_000], rows, atol=1e-6)
    y = (rng.random((9, 14)) < 0.4).astype(int)
    full = structure.configuration_model(y.sum(1), y.sum(0))
    assert np.allclose(full.sum(1), y.sum(1), atol=1e-5) and np.allclose(full.sum(0), y.sum(0), atol=1e-5)


def test_null_backbone_against_all_pairs(frames):
    coo, members, y = frames
    yes = np.nan_to_num(y)
    p = structure.configuration_model(yes.sum(1), yes.sum(0))
    shared, mean = yes @ yes.T, p @ p.T
    want = {}
    for a, b in itertools.combinations(range(20), 2):
        tail = structure._poisson_tail(shared[a, [b]], mean[a, [b]])[0]
        if tail < 0.6:
            want[f"v{a:02d}", f"v{b:02d}"] = (int(shared[a, b]), mean[a, b], tail)
    got = {(r["a"], r["b"]): (r["shared"], r["expected"], r["p"]) for r in structure.null_backbone(coo, members, 0.6).collect()}
    assert len(want) > 5 and got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_correspondence_counts_told_and_missing_absences_alike(spark, frames):
    _, members, y = frames
    told = [(f"v{i:02d}", j, "Absent" if np.isnan(y[i, j]) else "Yea" if y[i, j] else "Nay") for i in range(20) for j in range(90)]
    some = [r for k, r in enumerate(told) if r[2] != "Absent" or k % 2]
    one, two = (structure.correspondence(spark.createDataFrame(rows, "voter string, item long, cat string"), members).toPandas().set_index(["kind", "key", "dimension"]).sort_index() for rows in (told, some))
    assert len(one) == len(two) and np.allclose(one["coordinate"], two["coordinate"]) and np.allclose(one["share"], two["share"])
    z = np.array([[r[2] == c for r in told if r[1] == j] for j in range(90) for c in ("Absent", "Nay", "Yea")], float).T
    s = (z / z.sum() - z.sum(0) / z.sum() / 20) / np.sqrt(z.sum(0) / z.sum() / 20)
    d = np.linalg.svd(s, compute_uv=False)
    assert np.allclose(one.loc["inertia"]["coordinate"], d[:5] ** 2)
