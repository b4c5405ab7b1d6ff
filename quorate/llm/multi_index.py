"""Approximate nearest neighbours with an inverted multi-index.

The vector space is split into two halves and each half is quantised by its own small codebook,
fitted by k-means on a bounded sample (``SAMPLE`` vectors).  A cell is a pair of centroids; every
vector is indexed.  For a query the pairs are visited in order of summed distance with a heap
until the visited cells hold ``budget`` vectors; these are reranked by exact distance in double
precision.

Scale: the cells of one first centroid lie together and are cut into blocks of bounded size, and
so are the queries that visit them, so that no task sees a hot cell whole.  Of equal vectors only the ``k + 1`` with the smallest ids can be in a
result (ties go to the smaller id), so the others don't enter the index; nothing else is left out.

Vectors of any size and offset are compared alike: the index works on scaled, centred copies, the
preselection inside of a block allows for the rounding of its own scale, and what it keeps is measured
on the original vectors.

Defined results: vectors that are null, all zero, of another length than the commonest, or that
hold a null or non-finite component take no part, nor do rows without an id; fully repeated rows
count once; an id that stands on several vectors is one query and one candidate, at the smallest distance
of any of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 20_000
#: Centroids of each half, at most.
CODEBOOK = 128
BLOCK = 4096


def share_of(n: int) -> float:
    """Share of ``n`` entries that is reranked for a query: falls as neighbours of a growing table come closer."""
    return min(1.0, 0.56 * n**-0.05)


def codebook_of(n: int) -> int:
    """Centroids of each half for ``n`` entries: fine cells order entries well, so that fewer are visited."""
    return int(max(8, min(CODEBOOK, round(2.9 * n**0.5))))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector array<double>) of the rows that take part, without repeats."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where("vec_id is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)")
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (sizes["n"] if sizes else 0)).dropDuplicates(["vec_id", "vector"])


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        for j in range(k):
            own = x[near == j]
            centres[j] = own.mean(axis=0) if len(own) else x[rng.integers(len(x))]
    return centres


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :], 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_squared(x[i : i + 8192], centres).argmin(1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, int)


def visit(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, budget: int) -> list[int]:
    """Cells (i * k2 + j) in rising order of first[i] + second[j] until they hold ``budget`` entries."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a], second[b]
    heap, seen, out, held = [(float(x[0] + y[0]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < budget:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(b) + int(b[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (float(x[p] + y[q]), p, q))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distances(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pair of rows; sums of squares that leave the range of doubles are scaled."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        difference = q - e
        squares = (difference**2).sum(1)
        out = np.sqrt(squares)
        odd = np.flatnonzero(~np.isfinite(squares) | (squares < 1e-280))
        if len(odd):
            most = np.abs(difference[odd]).max(1)
            unit = difference[odd] / np.where((most > 0) & np.isfinite(most), most, 1)[:, None]
            out[odd] = np.where(np.isfinite(most), most * np.sqrt((unit**2).sum(1)), np.inf)
    return out


def preselect(q: np.ndarray, e: np.ndarray, visited: np.ndarray, second: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which pairs may be among a query's ``k`` nearest different ``ids`` in the cells it visits, rounding included.

    Entries lie by their cell ``second``; ``visited`` says for each query and cell whether the query goes there.  Distances are
    computed cell by cell between its entries and the queries that visit it, and for no other pair.
    """
    scale = max(np.abs(q).max(), np.abs(e).max())
    a, b = q / scale, e / scale
    centre = b.mean(axis=0)
    a, b = a - centre, b - centre
    near = np.full((len(q), len(e)), np.inf)
    opens = np.flatnonzero(np.r_[True, second[1:] != second[:-1]])
    for lo, hi in zip(opens, np.r_[opens[1:], len(e)], strict=True):
        some = np.flatnonzero(visited[:, second[lo]])
        if len(some):
            near[some, lo:hi] = np.sqrt(_squared(a[some], b[lo:hi]))
    near[own[:, None] == ids[None, :]] = np.inf
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
    if len(first) <= k:
        return np.isfinite(near)
    by_id = near if len(first) == len(ids) else np.minimum.reduceat(near[:, order], first, axis=1)
    eps, size = np.finfo(np.float64).eps, a.shape[1]
    longest = np.sqrt((a * a).sum(1).max()) + np.sqrt((b * b).sum(1).max())
    slack = 8 * eps * np.sqrt(size) + 2 * np.sqrt((size + 8) * eps) * longest
    return np.isfinite(near) & (near <= np.partition(by_id, k - 1, axis=1)[:, k - 1 : k] + slack)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", share: float | None = None, codebook: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest other rows by Euclidean distance.

    ``share`` of all entries, by default ``share_of`` their number, are reranked for each query.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vector_col)
    order = Window.partitionBy("vector").orderBy("vec_id")
    entries = rows.withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= k + 1).drop("copy")
    entries = common.materialise(entries, "vectors")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], schema)
    token = F.xxhash64("vec_id", "vector")
    sample = entries.where(F.pmod(token, F.lit(1 << 40)) < int(min(1.0, 1.5 * SAMPLE / n) * (1 << 40))).orderBy(token).limit(SAMPLE).select("vector").toPandas()
    x = np.array(sample["vector"].tolist()) if len(sample) else np.array([entries.first()["vector"]])
    scale = entries.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0]
    x = x / scale
    centre = x.mean(axis=0)
    x = x - centre
    half = x.shape[1] // 2
    size = codebook or codebook_of(n)
    books = spark.sparkContext.broadcast((kmeans(x[:, :half], size), kmeans(x[:, half:], size)))
    wide = len(books.value[1])
    budget = int(max(4 * k, (share_of(n) if share is None else share) * n))

    @common.tidy
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c1, c2 = books.value
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("vector")) / scale - centre
                cell = _nearest(m[:, :half], c1) * wide + _nearest(m[:, half:], c2)
                yield pa.record_batch([batch.column("vec_id"), batch.column("vector"), pa.array(cell.astype(np.int32))], names=["vec_id", "vector", "cell"])

    index = common.materialise(entries.mapInArrow(assign, "vec_id long, vector array<double>, cell int"), "index")
    sizes = np.zeros(len(books.value[0]) * wide, dtype=np.int64)
    for r in index.groupBy("cell").count().collect():  # one row per pair of centroids
        sizes[r["cell"]] = r["count"]
    held = spark.sparkContext.broadcast(sizes)

    @common.tidy
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c1, c2 = books.value
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column("vector")) / scale - centre
            d1, d2 = _squared(m[:, :half], c1), _squared(m[:, half:], c2)
            at, first, seconds = [], [], []
            for k in range(len(m)):
                cells = np.array(visit(d1[k], d2[k], held.value, budget), dtype=np.int64)
                for i in np.unique(cells // wide):
                    at.append(k)
                    first.append(int(i))
                    seconds.append((cells[cells // wide == i] % wide).tolist())
            take = pa.array(at, pa.int64())
            yield pa.record_batch([batch.column("vec_id").take(take), batch.column("vector").take(take), pa.array(first, pa.int32()), pa.array(seconds, pa.list_(pa.int32()))], names=["query_id", "vector", "first", "seconds"])

    asked = usable(queries, id_col, vector_col).where(F.size("vector") == x.shape[1])
    routed = common.materialise(asked.mapInArrow(route, "query_id long, vector array<double>, first int, seconds array<int>"), "routes")
    visits = {r["first"]: r["n"] for r in routed.groupBy("first").agg(F.count("*").alias("n")).collect()}
    per_row = sizes.reshape(-1, wide).sum(1)
    plan = pd.DataFrame({"first": np.flatnonzero(per_row).astype(np.int32)})
    plan["eb"] = [-(-int(per_row[i]) // BLOCK) for i in plan["first"]]
    plan["qb"] = [max(1, -(-visits.get(i, 0) // BLOCK)) for i in plan["first"]]
    blocks = F.broadcast(spark.createDataFrame(plan, "first int, eb int, qb int"))  # one row per centroid

    own = index.withColumns({"first": (F.col("cell") / wide).cast("int"), "second": F.col("cell") % wide}).join(blocks, "first")
    own = own.withColumn("e", F.pmod(F.xxhash64("vec_id"), F.col("eb")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1))).select("first", "e", "q", "vec_id", "vector", "second")
    asks = routed.join(blocks, "first").withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("qb")).cast("int"))
    asks = asks.withColumn("e", F.explode(F.sequence(F.lit(0), F.col("eb") - 1))).select("first", "e", "q", "query_id", "vector", "seconds")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        names, types = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        right = right.sort_by([("second", "ascending"), ("vec_id", "ascending")])
        q, e = _matrix(left.column("vector").combine_chunks()), _matrix(right.column("vector").combine_chunks())
        qid, eid = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        visited = np.zeros((len(q), wide), dtype=bool)
        for i, js in enumerate(left.column("seconds").to_pylist()):
            visited[i, js] = True
        second, out = right.column("second").to_numpy(), []
        for at in range(0, len(q), 512):
            own = qid[at : at + 512]
            i, j = np.nonzero(preselect(q[at : at + 512], e, visited[at : at + 512], second, own, eid, k))
            score = distances(q[at + i], e[j])
            s = np.lexsort((score, eid[j], i))
            i, j, score = i[s], j[s], score[s]
            once = np.r_[True, (i[1:] != i[:-1]) | (eid[j][1:] != eid[j][:-1])] if len(i) else np.zeros(0, bool)
            i, j, score = i[once], j[once], score[once]
            s = np.lexsort((eid[j], score, i))
            i, j, score = i[s], j[s], score[s]
            first = np.r_[0, np.flatnonzero(np.diff(i)) + 1] if len(i) else np.zeros(0, int)
            place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
            top = place < k
            out.append((own[i[top]], eid[j[top]], score[top]))
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    keys = ["first", "e", "q"]
    found = asks.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(lambda left, right: rerank(left, right), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # an id may be asked with several vectors
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(spark, sf_dir: str) -> DataFrame:
    rows = common.read_table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 100 = 0"))
