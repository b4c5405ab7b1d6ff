"""Vector search on repeated rows and on vectors of any size and offset."""

import random

import numpy as np
import pytest

from quorate.llm import multi_index

SCHEMA = "vec_id long, embedding array<double>, query_id string, rank string"


def brute(rows, query, k=10):
    """Nearest other ids of one id: the smallest distance over all its vectors and theirs."""
    best = {}
    for i, v in rows:
        if i == query:
            for j, w in rows:
                if j != query:
                    d = multi_index.distances(np.array([v]), np.array([w]))[0]
                    best[j] = min(best.get(j, np.inf), d)
    return [j for _, j in sorted((d, j) for j, d in best.items())][:k]


def vectors(n=60, size=6):
    rng = np.random.default_rng(3)
    return [(i, rng.normal(size=size).tolist()) for i in range(n)]


CASES = {
    "repeated query row": lambda rows: [*rows, rows[0], rows[0]],
    "query id on several vectors": lambda rows: [*rows, (0, rows[7][1]), (0, [9.0] * 6)],
    "candidate id on several vectors": lambda rows: [*rows, *((5, (np.array(rows[0][1]) + 0.01 * k).tolist()) for k in range(30))],
    "far from the origin": lambda rows: [(i, (np.array(v) + 1e8).tolist()) for i, v in rows],
    "very large": lambda rows: [(i, (np.array(v) * 1e200).tolist()) for i, v in rows],
    "very small": lambda rows: [(i, (np.array(v) * 1e-200).tolist()) for i, v in rows],
    "one outlier": lambda rows: [*rows, (99, [1e200] * 6)],
    "equal vectors": lambda rows: [*rows, *((100 + k, rows[0][1]) for k in range(40))],
}


@pytest.mark.parametrize("case", CASES)
def test_all_neighbours_are_found(spark, case):
    rows = CASES[case](vectors())
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    got = {}
    for r in multi_index.search(table, table.where("vec_id % 10 = 0"), share=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == {i for i, _ in rows if i % 10 == 0}
    for query, found in got.items():
        assert found == brute(rows, query), query


def test_recall_of_the_query(spark, tiny):
    rows = spark.read.parquet(f"{tiny.replace('0.001', '0.1')}/embeddings.parquet")
    table = [(r.vec_id, r.embedding) for r in rows.collect()]
    matrix, ids = np.array([v for _, v in table], dtype=float), np.array([i for i, _ in table])
    found, hits = multi_index.op9(spark, tiny.replace("0.001", "0.1")).collect(), 0
    for r in found:
        d = np.sqrt(((matrix - matrix[ids == r.query_id][0]) ** 2).sum(1))
        d[ids == r.query_id] = np.inf
        hits += r.vec_id in ids[np.lexsort((ids, d))[:10]]
    assert hits >= 0.9 * len(found) == 0.9 * 10 * (ids % 100 == 0).sum()


def test_distances_are_computed_in_visited_cells_only(tiny, monkeypatch):
    """At sf0.1: under half of all distances, counted, for a recall of at least 0.9."""
    import pyarrow.parquet as pq

    rows = pq.read_table(tiny.replace("0.001", "0.1") + "/embeddings.parquet").to_pydict()
    x = np.array([v for v in rows["embedding"] if v is not None], dtype=float)
    ids, n, half = np.arange(len(x)), len(x), x.shape[1] // 2
    size = multi_index.codebook_of(n)
    books = multi_index.kmeans(x[:, :half], size), multi_index.kmeans(x[:, half:], size)
    cells = [multi_index._nearest(x[:, :half], books[0]), multi_index._nearest(x[:, half:], books[1])]
    q, own = x[::100], ids[::100]
    sizes = np.bincount(cells[0] * size + cells[1], minlength=size * size)
    routes = [multi_index._squared(q[:, :half], books[0]), multi_index._squared(q[:, half:], books[1])]
    went = [set(multi_index.visit(routes[0][k], routes[1][k], sizes, int(multi_index.share_of(n) * n))) for k in range(len(q))]
    counted, plain = [], multi_index._squared
    monkeypatch.setattr(multi_index, "_squared", lambda a, b: counted.append(len(a) * len(b)) or plain(a, b))
    hits = 0
    near = np.sqrt(plain(q, x))
    near[np.arange(len(q)), own] = np.inf
    best = np.argsort(near, axis=1)[:, :10]
    kept = np.zeros((len(q), n), bool)
    for first in range(size):
        e = np.flatnonzero(cells[0] == first)
        e = e[np.argsort(cells[1][e], kind="stable")]
        asks = np.array([k for k in range(len(q)) if any(c // size == first for c in went[k])], dtype=int)
        if len(e) and len(asks):
            visited = np.array([[first * size + j in went[k] for j in range(size)] for k in asks])
            kept[np.ix_(asks, e)] = multi_index.preselect(q[asks], x[e], visited, cells[1][e], own[asks], ids[e], 10)
    hits = kept[np.arange(len(q))[:, None], best].mean()
    assert sum(counted) < 0.45 * n * len(q) and hits >= 0.9


def test_neighbours_with_clashing_columns(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(6)]) for i in range(60)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    odd = plain.selectExpr("*", "1 as cell", "2 as first", "3 as q", "4 as copy", "'v' as vector", "'i' as query_id")
    found = [sorted(map(tuple, multi_index.search(df, df.where("vec_id % 10 = 0"), share=1.0).collect())) for df in (plain, odd)]
    assert found[0] == found[1] and len(found[0]) == 60
