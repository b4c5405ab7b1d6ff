"""Structure of a chamber's votes: components and their checks, correspondence analysis, clusters, communities, null models.

A kernel gets one chamber (or one graph) per task as NumPy arrays: its known cells and at most squares of its voters,
never its table of voters by items.  Resamples and draws of noise are tasks of their own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written
from . import ranks
from .latent import with_group
from .meetings import meetings
from .sparse_votes import STEP, Cells, Standard, by_chamber, crossed, read
from .sweeps import Block, Dealt, greatest, large


def _filled(m: np.ndarray) -> np.ndarray:
    """Missing cells at the voter's own mean; 0.5 for a voter without any."""
    known = ~np.isnan(m)
    mean = np.where(known.any(1), np.nansum(m, 1) / np.maximum(known.sum(1), 1), 0.5)
    return np.where(known, m, mean[:, None])


def _standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    centre, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 0, scale, 1)
    return (x - centre) / scale, centre, scale


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared singular values, greatest first, by the smaller Gram matrix."""
    gram = x @ x.T if len(x) <= x.shape[1] else x.T @ x
    return np.clip(np.linalg.eigvalsh(gram)[::-1], 0, None)


def _sign(score: np.ndarray, party: np.ndarray) -> float:
    """-1 where Republicans have the smaller mean."""
    one = party == "Republican"
    return -1.0 if one.any() and (~one).any() and score[one].mean() < score[~one].mean() else 1.0


# ---------------------------------------------------------------- principal components

#: Rows below which all eigenvalues are as cheap as the first ones.
ALL = 500


def noise_gram(n: int, p: int, rng: np.random.Generator) -> np.ndarray:
    """Products of the rows of a standardised table of normal noise with at least as many columns, drawn by blocks of columns.

    Noise and the products of a block are of single precision, which is twice as fast; blocks are added up in double.
    """
    gram, width = np.zeros((n, n)), max(1, 4 * STEP // n)
    for a in range(0, p, width):
        x = rng.standard_normal((min(width, p - a), n), dtype=np.float32)
        x -= x.mean(1, keepdims=True)
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x) / n), 1e-30)[:, None]
        gram += x.T @ x
    return gram


def noise_squares(n: int, p: int, rng: np.random.Generator, k: int | None = None) -> np.ndarray:
    """Squared singular values, greatest first, of a standardised table of normal noise: all, or the first ``k`` without the others.

    No more is held than the square of the rows and a block, or the table where it has fewer columns than rows.
    """
    if p < n:
        return _squares(_standard(rng.standard_normal((p, n)).T)[0])[:k]
    gram = noise_gram(n, p, rng)
    if k is None or n < ALL:
        return np.clip(np.linalg.eigvalsh(gram)[::-1], 0, None)[:k]
    solver = greatest(n, k, tolerance=1e-5)  # of the vectors; values are right to its square
    asked = next(solver)
    while True:
        try:
            asked = solver.send(gram @ asked)
        except StopIteration as end:
            return end.value[0]


def component_count(coo: DataFrame, members: DataFrame, k: int = 5, draws: int = 100, seed: int = 42) -> DataFrame:
    """(chamber, component, eigenvalue, explained, chance, keep): parallel analysis.

    ``chance`` is the 95th percentile of the eigenvalue over ``draws`` tables of normal noise of the same shape.
    """

    rows = with_group(coo, members)

    def fit(c: Cells) -> pd.DataFrame:
        _, s, share = Standard(c).components(k)
        return pd.DataFrame({"chamber": c.chamber, "component": np.arange(1, len(s) + 1), "eigenvalue": s**2 / max(len(c.voters) - 1, 1), "explained": share})

    def noise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chamber, n, p, draw in batch[["chamber", "n", "p", "draw"]].itertuples(index=False):
                values = noise_squares(n, p, np.random.default_rng([seed, draw]), min(k, n, p)) / max(n - 1, 1)
                yield pd.DataFrame({"chamber": chamber, "component": np.arange(1, len(values) + 1), "value": values})

    # one row a chamber meets one row a draw, and each draw is a task
    shapes = rows.groupBy("chamber").agg(F.countDistinct("voter").alias("n"), F.countDistinct("item").alias("p"))
    tasks = coo.sparkSession.range(0, draws, 1, draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(shapes))
    chance = tasks.mapInPandas(noise, "chamber string, component int, value double").groupBy("chamber", "component").agg(F.percentile("value", 0.95).alias("chance"))
    values = by_chamber(rows, fit, "chamber string, component int, eigenvalue double, explained double")
    return values.join(chance, ["chamber", "component"]).withColumn("keep", F.col("eigenvalue") > F.col("chance"))


def loadings(coo: DataFrame, members: DataFrame, k: int = 2) -> DataFrame:
    """(chamber, item, component, loading): unit right vectors, the first with Republicans above."""

    def fit(c: Cells) -> pd.DataFrame:
        z = Standard(c)
        u, s, _ = z.components(k)
        v = z.right(u, s)
        v[0] *= _sign(u[:, 0] * s[0], c.party)
        return pd.concat([pd.DataFrame({"chamber": c.chamber, "item": c.items, "component": t + 1, "loading": v[t]}) for t in range(len(v))])

    rows, schema = with_group(coo, members), "chamber string, item long, component int, loading double"
    if not large(rows):
        return by_chamber(rows, fit, schema)
    dealt = Dealt(rows)
    found = {c: (u, s, _dealt_sign(u[:, 0] * s[0], dealt.sides[c])) for c, (u, s, _) in dealt.components(k).items()}

    def tell(block: Block, fill: np.ndarray, u: np.ndarray, s: np.ndarray, sign: float) -> list[dict]:
        v = _right(block, fill, u, s)
        v[0] *= sign
        return [{"item": block.items, "component": np.full(len(block.items), t + 1), "loading": v[t]} for t in range(len(v))]

    return dealt.by_item(found, tell, schema)


def _dealt_sign(score: np.ndarray, side: np.ndarray) -> float:
    return _sign(score, np.where(side, "Republican", ""))


def _right(block: Block, fill: np.ndarray, u: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Right vectors (components x items) of a block."""
    off = block.y - fill[block.i]
    return np.array([block.right(fill, off, u[:, t]) / s[t] if s[t] > 1e-9 * s[0] else np.zeros(len(block.lens)) for t in range(len(s))])


def reconstruction(coo: DataFrame, members: DataFrame, k: int = 5, deviations: float = 2.0) -> DataFrame:
    """(chamber, voter, rmse, flag): error of the rank-``k`` table, flagged above the mean by ``deviations``."""

    def fit(c: Cells) -> pd.DataFrame:
        z = Standard(c)
        u, s, _ = z.components(k)
        v, score, total = z.right(u, s), u * s, np.zeros(z.n)
        for at, x in z.blocks():
            total += ((score @ v[:, at] * z.scale[at] + z.centre[at] - x) ** 2).sum(1)
        rmse = np.sqrt(total / z.p)
        return pd.DataFrame({"chamber": c.chamber, "voter": c.voters, "rmse": rmse, "flag": rmse > rmse.mean() + deviations * rmse.std()})

    rows, schema = with_group(coo, members), "chamber string, voter string, rmse double, flag boolean"
    if not large(rows):
        return by_chamber(rows, fit, schema)
    dealt, found = Dealt(rows), {}
    parts = dealt.components(k)

    def add(block: Block, fill: np.ndarray, held: np.ndarray) -> np.ndarray:
        # an error is that of a row (score, 1, -fill) times a column, less the cell's distance from the fill: its square is summed over cells, not over the table
        u, s = held[:-1, 1:], held[-1, 1:]
        row = np.hstack([u * s, np.ones((len(fill), 1)), -fill[:, None]])
        off, v = block.y - fill[block.i], _right(block, fill, u, s)
        column = np.vstack([v * block.scale, block.centre, np.ones(len(block.lens))])
        both = sum(row[block.i, t] * column[t, block.j] for t in range(len(column)))
        total = ((row @ (column @ column.T)) * row).sum(1) + np.bincount(block.i, off * off - 2 * off * both, len(fill))
        return total[:, None]

    total = dealt.sums(add, {c: np.vstack([np.hstack([np.zeros((len(u), 1)), u]), np.r_[0.0, s]]) for c, (u, s, _) in parts.items()}, 1)
    for c, sums in total.items():
        rmse = np.sqrt(np.clip(sums[:, 0], 0, None) / dealt.items[c])
        found[c] = rmse, rmse > rmse.mean() + deviations * rmse.std()
    return dealt.by_voter(found, lambda c, code, rmse, flag: [{"rmse": rmse[code], "flag": flag[code]}], schema)


def _auc(y: np.ndarray, p: np.ndarray) -> float | None:
    pos, neg = np.sort(p[y == 1]), np.sort(p[y == 0])
    if not len(pos) or not len(neg):
        return None
    won = (np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / 2
    return float(won / (len(pos) * len(neg)))


def component_holdout(coo: DataFrame, members: DataFrame, k: int = 5, share: float = 0.2, seed: int = 42) -> DataFrame:
    """(chamber, n, accuracy, auc, rmse, baseline): a share of the cells is masked and predicted from the rest."""

    def fit(c: Cells) -> pd.DataFrame:
        pick = np.random.default_rng(seed).choice(len(c.i), int(len(c.i) * share), replace=False)
        if not len(pick):
            return pd.DataFrame({"chamber": [c.chamber], "n": [0], "accuracy": [None], "auc": [None], "rmse": [None], "baseline": [None]})
        i, j, truth = c.i[pick], c.j[pick], c.y[pick]
        rest = np.ones(len(c.i), bool)
        rest[pick] = False
        z = Standard(replace(c, i=c.i[rest], j=c.j[rest], y=c.y[rest]))
        u, s, _ = z.components(k)
        v = z.right(u, s)
        guess = sum(u[i, t] * s[t] * v[t, j] for t in range(len(s))) * z.scale[j] + z.centre[j]
        return pd.DataFrame({"chamber": [c.chamber], "n": [len(i)], "accuracy": [((guess >= 0.5) == (truth == 1)).mean()], "auc": [_auc(truth, np.clip(guess, 0, 1))], "rmse": [math.sqrt(((guess - truth) ** 2).mean())], "baseline": [max(truth.mean(), 1 - truth.mean())]})

    rows = with_group(coo, members)
    return _dealt_holdout(rows, k, share, seed) if large(rows) else by_chamber(rows, fit, "chamber string, n long, accuracy double, auc double, rmse double, baseline double")


def drawn(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """(chamber, voter, party, item, y) with ``held``: true for exactly a ``share`` of each chamber's known cells, those of the smallest hashes."""
    hashed = rows.withColumn("hash", F.xxhash64(F.lit(seed), "voter", "item")).withColumn("bucket", F.shiftrightunsigned("hash", 48))
    known = hashed.where("y IS NOT NULL")
    over = Window.partitionBy("chamber").orderBy("bucket")  # one row a bucket, of 65,536
    upto = known.groupBy("chamber", "bucket").agg(F.count("*").alias("size")).withColumns({"upto": F.sum("size").over(over), "all": F.sum("size").over(Window.partitionBy("chamber"))})
    least = upto.withColumn("wanted", F.floor(F.col("all") * share)).where("upto - size <= wanted AND wanted < upto")
    last = F.broadcast(least.select("chamber", F.col("bucket").alias("last"), (F.col("wanted") - F.col("upto") + F.col("size")).alias("more")))
    edge = known.join(last, "chamber").where("bucket = last").withColumn("place", F.row_number().over(Window.partitionBy("chamber").orderBy("hash", "voter", "item")))
    edge = F.broadcast(edge.where("place <= more").select("chamber", "voter", "item", F.lit(True).alias("picked")))  # of one bucket
    out = hashed.join(last, "chamber", "left").join(edge, ["chamber", "voter", "item"], "left")
    held = F.col("y").isNotNull() & ((F.col("bucket") < F.coalesce("last", F.lit(1 << 17))) | F.coalesce("picked", F.lit(False)))
    return out.select(*rows.columns, held.alias("held"))


def _dealt_holdout(rows: DataFrame, k: int, share: float, seed: int) -> DataFrame:
    cells = written(drawn(rows, share, seed))
    dealt = Dealt(cells.withColumn("y", F.when(~F.col("held"), F.col("y"))).drop("held"))
    parts = dealt.components(k)

    def tell(block: Block, fill: np.ndarray, u: np.ndarray, s: np.ndarray) -> list[dict]:
        return [{"item": block.items, "column": list((_right(block, fill, u, s) * block.scale).T), "centre": block.centre}]

    columns = dealt.by_item({c: (u, s) for c, (u, s, _) in parts.items()}, tell, "chamber string, item long, column array<double>, centre double")
    scores = dealt.by_voter({c: (u * s,) for c, (u, s, _) in parts.items()}, lambda c, code, score: [{"score": list(score[code])}], "chamber string, voter string, score array<double>")
    guess = F.aggregate(F.zip_with("score", "column", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) + F.col("centre")
    told = written(cells.where("held").join(columns, ["chamber", "item"]).join(scores, ["chamber", "voter"]).select("chamber", "y", guess.alias("guess")))
    ranked = ranks.with_ranks(told.withColumn("p", F.least(F.greatest("guess", F.lit(0.0)), F.lit(1.0))), {"rank": "p"}, ["chamber"])
    yea = (F.col("y") == 1).cast("double")
    out = ranked.groupBy("chamber").agg(F.count("*").alias("n"), F.avg(((F.col("guess") >= 0.5) == (F.col("y") == 1)).cast("double")).alias("accuracy"), F.sum(F.col("rank") * yea).alias("won"), F.sum(yea).alias("one"), F.sqrt(F.avg((F.col("guess") - F.col("y")) ** 2)).alias("rmse"), F.avg("y").alias("mean"))
    auc = F.try_divide(F.col("won") - F.col("one") * (F.col("one") + 1) / 2, F.col("one") * (F.col("n") - F.col("one")))
    out = dealt.voters.select("chamber").distinct().join(out, "chamber", "left")
    return out.select("chamber", F.coalesce("n", F.lit(0)).alias("n"), "accuracy", auc.alias("auc"), "rmse", F.greatest("mean", 1 - F.col("mean")).alias("baseline"))


def second_component(scores: DataFrame) -> DataFrame:
    """(chamber, r2, voter, score, extreme) from (chamber, voter, component, score): does the second component fold over the first?

    ``r2`` is that of a parabola; ``extreme`` where the least score lies more than three deviations from zero.
    """
    wide = scores.groupBy("chamber", "voter").agg(*(F.max(F.when(F.col("component") == c, F.col("score"))).alias(f"c{c}") for c in (1, 2))).dropna()

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows["c1"].to_numpy(), rows["c2"].to_numpy()
        a = np.stack([np.ones_like(x), x, x * x], 1)
        rest = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
        total = ((y - y.mean()) ** 2).sum()
        low = rows.sort_values(["c2", "voter"]).iloc[0]
        sd = y.std(ddof=1) if len(y) > 1 else np.nan
        return pd.DataFrame({"chamber": [rows["chamber"].iloc[0]], "r2": [1 - (rest**2).sum() / total if total > 0 else 0.0], "voter": [low["voter"]], "score": [low["c2"]], "extreme": [bool(abs(low["c2"]) > 3 * sd)]})

    return wide.groupBy("chamber").applyInPandas(fit, "chamber string, r2 double, voter string, score double, extreme boolean")


# ---------------------------------------------------------------- correspondence analysis


def correspondence(categories: DataFrame, members: DataFrame, k: int = 5) -> DataFrame:
    """Multiple correspondence analysis of (voter, item, cat) by chamber; a missing cell is a category ``Absent``.

    (chamber, kind, key, dimension, coordinate, share): ``voter`` rows have cos2 as share, ``category``
    rows ("item|cat") their contribution, ``inertia`` rows the eigenvalue and its share after Greenacre's correction.
    Republicans are above zero on the first dimension.
    """

    arrow = pa.schema([("chamber", pa.string()), ("kind", pa.string()), ("key", pa.string()), ("dimension", pa.int32()), ("coordinate", pa.float64()), ("share", pa.float64())])

    def fit(table: pa.Table) -> pa.Table:
        c, cats = read(table), table.column("cat")
        n, q = len(c.voters), len(c.items)
        kinds = np.unique(np.array(cats.unique().drop_null().to_pylist()))
        there = kinds[c.y.astype(int)] != "Absent"  # told or missing, an absence is the same
        i, j, codes = c.i[there], c.j[there], c.j[there].astype(np.int64) * len(kinds) + c.y[there].astype(int)
        column, h, count = np.unique(codes, return_inverse=True, return_counts=True)
        away = n - np.bincount(j, minlength=q)
        gap = np.flatnonzero(away)  # items with an absence
        # table of voters by categories, each 1 over the category's voters, times itself: said categories, then absences
        part = np.where(away > 0, 1 / np.maximum(away, 1), 0.0)
        one = np.bincount(i, part[j], n)
        gram = crossed(i, h, n, len(column), 1 / count[h], np.ones(len(i))) + crossed(i, j, n, q, part[j], np.ones(len(i)))
        gram += part.sum() - one[:, None] - one
        gram = gram / q - 1 / n
        e, u = np.linalg.eigh(gram)
        eigen, u = np.clip(e[::-1], 0, None), u[:, ::-1]
        dims = max(1, min(k, int((eigen > 1e-12 * max(eigen[0], 1e-300)).sum())))
        u, d = u[:, :dims].copy(), np.sqrt(eigen[:dims])
        u *= np.where(u[np.abs(u).argmax(0), np.arange(dims)] < 0, -1.0, 1.0)
        u[:, 0] *= _sign(u[:, 0], c.party)
        cos2 = (u * d) ** 2 / np.maximum(np.diag(gram), 1e-300)[:, None]
        del gram
        total = len(column) + len(gap)
        names = pc.binary_join_element_wise(pa.array(np.r_[c.items[column // len(kinds)], c.items[gap]]).cast(pa.string()), pa.array(np.r_[kinds[column % len(kinds)], np.full(len(gap), "Absent")].astype(object), pa.string()), "|")
        mass = np.r_[count, away[gap]] / (n * q)
        kept = eigen[eigen > 1 / q] if q > 1 else eigen[:0]
        corrected = (q / (q - 1) * (kept - 1 / q)) ** 2 if q > 1 else kept
        average = q / (q - 1) * ((eigen**2).sum() - (total - q) / q**2) if q > 1 else 0.0
        parts = []

        def add(kind: str, key: pa.Array, t: int, coordinate: np.ndarray, share: np.ndarray) -> None:
            m = len(key)
            parts.append(pa.table([pa.repeat(c.chamber, m), pa.repeat(kind, m), key, pa.repeat(pa.scalar(t + 1, pa.int32()), m), pa.array(coordinate), pa.array(share)], schema=arrow))

        for t in range(dims):
            absent = u[:, t].sum() - np.bincount(j, u[i, t], q)
            v = (np.r_[np.bincount(h, u[i, t], len(column)), absent[gap]] / (n * q) - mass * u[:, t].sum() / n) / np.sqrt(mass / n)
            v = v / d[t] if d[t] > 0 else np.zeros(total)
            add("voter", pa.array(c.voters, pa.string()), t, u[:, t] * d[t] * math.sqrt(n), cos2[:, t])
            add("category", names, t, v * d[t] / np.sqrt(mass), v**2)
            add("inertia", pa.array([str(t + 1)]), t, eigen[[t]], np.array([corrected[t] / average if t < len(corrected) and average > 0 else 0.0]))
        return pa.concat_tables(parts)

    # a category's place in the order of the chamber's categories stands for it
    rows = categories.join(members.select("voter", "chamber", "party"), "voter").select("chamber", "voter", "party", "item", "cat")
    known = rows.groupBy("chamber").agg(F.array_sort(F.collect_set("cat")).alias("kinds"))
    rows = rows.join(F.broadcast(known), "chamber").select("chamber", "voter", "party", "item", "cat", (F.array_position("kinds", F.col("cat")) - 1).cast("double").alias("y"))
    return rows.groupBy("chamber").applyInArrow(fit, "chamber string, kind string, key string, dimension int, coordinate double, share double")


# ---------------------------------------------------------------- clusters of members


def average_linkage(d: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (one, other, height, size) of a distance matrix; new clusters are numbered from n on, ties go to the first pair."""
    n = len(d)
    d = np.array(d, float)
    np.fill_diagonal(d, np.inf)
    ids, size, merges = list(range(n)), np.ones(n), []
    # at most a row's least distance: rows whose nearest went away are read again only when they come first
    low = d.min(1) if n else np.empty(0)
    for step in range(n - 1):
        while True:
            i = int(np.argmin(low))
            j = int(np.argmin(d[i]))
            if d[i, j] <= low[i]:
                break
            low[i] = d[i, j]
        i, j = min(i, j), max(i, j)
        merges.append((min(ids[i], ids[j]), max(ids[i], ids[j]), float(d[i, j]), int(size[i] + size[j])))
        mixed = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        mixed[i] = mixed[j] = np.inf
        d[i], d[:, i] = mixed, mixed
        d[j], d[:, j] = np.inf, np.inf
        low = np.minimum(low, mixed)
        low[i], low[j] = mixed.min(), np.inf
        size[i] += size[j]
        ids[i] = n + step
    return merges


def cut(merges: list[tuple[int, int, float, int]], n: int, k: int) -> np.ndarray:
    """Labels from 0 by first member, with the last ``k`` - 1 merges undone."""
    of = {i: [i] for i in range(n)}
    for step, (a, b, _, _) in enumerate(merges[: max(n - k, 0)]):
        of[n + step] = of.pop(a) + of.pop(b)
    out = np.empty(n, int)
    for label, group in enumerate(sorted(of.values(), key=min)):
        out[group] = label
    return out


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette; members alone in their cluster count 0."""
    groups = np.unique(labels)
    if len(groups) < 2:
        return 0.0
    sums = np.stack([d[:, labels == g].sum(1) for g in groups], 1)
    sizes = np.array([(labels == g).sum() for g in groups])
    own = np.searchsorted(groups, labels)
    at = np.arange(len(d))
    inside = sums[at, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes
    means[at, own] = np.inf
    outside = means.min(1)
    top = np.maximum(inside, outside)
    return float(np.where((sizes[own] > 1) & (top > 0), (outside - inside) / np.where(top > 0, top, 1), 0).mean())


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, starts: int = 10) -> np.ndarray:
    best = None
    for _ in range(starts):
        centres = x[rng.choice(len(x), 1)]
        while len(centres) < k:
            gap = ((x[:, None] - centres) ** 2).sum(2).min(1)
            centres = np.vstack([centres, x[rng.choice(len(x), p=gap / gap.sum() if gap.sum() > 0 else None)]])
        for _ in range(100):
            labels = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
            fresh = np.stack([x[labels == g].mean(0) if (labels == g).any() else centres[g] for g in range(k)])
            if np.allclose(fresh, centres):
                break
            centres = fresh
        inertia = ((x - centres[labels]) ** 2).sum()
        if best is None or inertia < best[0] - 1e-12:
            best = (inertia, labels)
    return best[1]


def _mixture(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(BIC, labels) of a mixture of normals with a variance for each component and column."""
    n, p = x.shape
    floor = 1e-6 + 1e-3 * x.var(0)
    post = np.eye(k)[kmeans(x, k, rng, 3)]
    before = -np.inf
    for _ in range(rounds):
        w = post.sum(0) + 1e-9
        mean = post.T @ x / w[:, None]
        var = np.maximum(post.T @ x**2 / w[:, None] - mean**2, floor)
        log = np.log(w / n) - 0.5 * (((x[:, None] - mean) ** 2 / var) + np.log(2 * np.pi * var)).sum(2)
        top = log.max(1, keepdims=True)
        like = top[:, 0] + np.log(np.exp(log - top).sum(1))
        post = np.exp(log - like[:, None])
        if like.sum() - before < 1e-8:
            break
        before = like.sum()
    return -2 * like.sum() + (k - 1 + 2 * k * p) * math.log(n), post.argmax(1)


def _by_first(labels: np.ndarray) -> np.ndarray:
    """The same partition with labels numbered by first member."""
    _, first, back = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[back]


def kappa_distances(y: np.ndarray, shared: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(distance, kappa) between rows of a vote table with gaps; pairs that share too few items get the greatest distance."""
    seen, yes = (~np.isnan(y)).astype(float), np.nan_to_num(y)
    return _distances(seen @ seen.T, yes @ yes.T, yes @ seen.T, shared)


def _distances(n: np.ndarray, both: np.ndarray, one: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, kappa) from the items and Yeas that two voters have in common and the Yeas of one where the other voted; rows go by blocks."""
    kappa, step = np.empty_like(n), max(1, STEP // max(len(n), 1))
    for at in (slice(a, a + step) for a in range(0, len(n), step)):
        met, mine, theirs = n[at], one[at], one[:, at].T
        with np.errstate(invalid="ignore", divide="ignore"):
            agree = (met - mine - theirs + 2 * both[at]) / met
            pa, pb = mine / met, theirs / met
            chance = pa * pb + (1 - pa) * (1 - pb)
            kappa[at] = np.where(met >= shared, np.where(chance > 1 - 1e-12, 1.0, (agree - chance) / (1 - chance)), np.nan)
    d = 1 - kappa
    unknown = np.isnan(d)
    d[unknown] = d[~unknown].max() if not unknown.all() else 1.0
    np.clip(d, 0, None, out=d)
    np.fill_diagonal(d, 0)
    return d, kappa


def cell_distances(c: Cells, shared: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``kappa_distances`` from known cells, each item counted as often as ``times`` says."""
    n, p = len(c.voters), len(c.items)
    often = np.ones(len(c.i)) if times is None else times[c.j].astype(float)
    at = often > 0
    i, j, y, often = c.i[at], c.j[at], c.y[at], often[at]
    one = np.ones(len(i))
    return _distances(crossed(i, j, n, p, often, one), crossed(i, j, n, p, often * y, y), crossed(i, j, n, p, often * y, one), shared)


def _straight(x: np.ndarray) -> np.ndarray:
    """Straight distances between rows, a column at a time."""
    out = np.zeros((len(x), len(x)))
    for column in x.T:
        gap = column[:, None] - column
        gap *= gap
        out += gap
    return np.sqrt(out, out=out)


def member_clusters(coo: DataFrame, members: DataFrame, sizes: tuple[int, ...] = (2, 3, 4, 5, 6, 7), shared: int = 10, seed: int = 42) -> DataFrame:
    """(chamber, method, clusters, quality, voter, cluster): the best number of clusters by each method.

    ``average linkage`` and ``spectral`` work on kappa, ``k-means`` and ``mixture`` on the Yea rate and first component.
    Quality is the silhouette, for the mixture the least BIC.  Clusters are numbered by their first voter.
    """

    def fit(c: Cells) -> pd.DataFrame:
        n, rng = len(c.voters), np.random.default_rng(seed)
        z = Standard(c)
        u, s, _ = z.components(1)
        points = _standard(np.stack([u[:, 0] * s[0] * _sign(u[:, 0] * s[0], c.party), z.fill], 1))[0]
        d, kappa = cell_distances(c, shared)
        tries = [k for k in sizes if k < n]
        tree = average_linkage(d)
        affinity = np.clip(np.nan_to_num(kappa, copy=False), 0, None, out=kappa)
        np.fill_diagonal(affinity, 0)
        root = 1 / np.sqrt(np.maximum(affinity.sum(1), 1e-12))
        affinity *= root[:, None]
        affinity *= root
        basis = np.linalg.eigh(affinity)[1][:, : -max(tries, default=1) - 1 : -1].copy()
        straight = _straight(points)

        def spectral(k: int) -> np.ndarray:
            e = basis[:, :k]
            return kmeans(e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12), k, rng)

        found = []
        for method, labels, space in (("average linkage", lambda k: cut(tree, n, k), d), ("spectral", spectral, d), ("k-means", lambda k: kmeans(points, k, rng), straight)):
            best = max(((silhouette(space, found_), -k, found_) for k in tries for found_ in [labels(k)]), key=lambda t: t[:2], default=(0.0, -1, np.zeros(n, int)))
            found.append((method, best[0], best[2]))
        mixtures = [(*_mixture(points, k, rng), k) for k in (1, *tries)] if n else []
        bic, labels, _ = min(mixtures, key=lambda t: (t[0], t[2]))
        found.append(("mixture", bic, labels))
        return pd.concat([pd.DataFrame({"chamber": c.chamber, "method": name, "clusters": len(np.unique(lab)), "quality": quality, "voter": c.voters, "cluster": _by_first(lab)}) for name, quality, lab in found])

    return by_chamber(with_group(coo, members), fit, "chamber string, method string, clusters int, quality double, voter string, cluster int")


#: Resamples of a task of ``clade_support``.
RESAMPLES = 4


def _spans(merges: list[tuple[int, int, float, int]], place: np.ndarray) -> list[tuple[int, int] | None]:
    """(first, last) place of each merge's members, None where others stand between them."""
    ends, out = [(x, x, 1) for x in place.tolist()], []
    for a, b, _, size in merges:
        low, high = min(ends[a][0], ends[b][0]), max(ends[a][1], ends[b][1])
        ends.append((low, high, size))
        out.append((low, high) if high - low + 1 == size else None)
    return out


def leaf_order(merges: list[tuple[int, int, float, int]], n: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(place of each member, span of each merge): an order in which the members of every merge are neighbours.

    Another tree has a merge of the same members where that merge's places are such a span without gaps, so no sets are compared.
    """
    start, size = np.zeros(n + len(merges), int), np.r_[np.ones(n, int), np.array([m[3] for m in merges], int)]
    for step in range(len(merges) - 1, -1, -1):
        a, b, _, _ = merges[step]
        start[a], start[b] = start[n + step], start[n + step] + size[a]
    return start[:n], _spans(merges, start[:n])


def clade_support(coo: DataFrame, members: DataFrame, replicates: int = 100, shared: int = 10, seed: int = 42) -> DataFrame:
    """(chamber, voters, height, support): for each merge of the average linkage, the share of item resamples that hold it.

    ``voters`` is the sorted list of the merge's members, joined by commas.
    """

    starts = range(0, replicates, RESAMPLES)
    arrow = pa.schema([("chamber", pa.string()), ("step", pa.int32()), ("voters", pa.string()), ("height", pa.float64()), ("hits", pa.int64())])

    def fit(table: pa.Table) -> pa.Table:
        c, first = read(table), table.column("first")[0].as_py()
        n, p = len(c.voters), len(c.items)
        mine = average_linkage(cell_distances(c, shared)[0])
        place, spans = leaf_order(mine, n)
        known, hits, rng = {span: step for step, span in enumerate(spans)}, np.zeros(len(mine), int), np.random.default_rng(seed)
        for r in range(min(first + RESAMPLES, replicates)):
            drawn = rng.integers(0, p, p)
            if r >= first:
                found = [known.get(span) for span in _spans(average_linkage(cell_distances(c, shared, np.bincount(drawn, minlength=p))[0]), place)]
                hits[[step for step in found if step is not None]] += 1
        names = [None] * len(mine)
        if first == 0:  # the first task of a chamber tells its merges
            order = np.argsort(place)
            names = [",".join(c.voters[np.sort(order[a : b + 1])]) for a, b in spans]
        return pa.table([[c.chamber] * len(mine), np.arange(len(mine), dtype=np.int32), names, [m[2] for m in mine], hits], schema=arrow)

    spark = coo.sparkSession
    tasks = spark.createDataFrame([(s,) for s in starts or [0]], "first int")
    dealt = with_group(coo, members).crossJoin(F.broadcast(tasks)).repartition(4 * len(starts or [0]), "chamber", "first")
    found = dealt.groupBy("chamber", "first").applyInArrow(fit, "chamber string, step int, voters string, height double, hits long")
    merged = found.groupBy("chamber", "step").agg(F.max("voters").alias("voters"), F.max("height").alias("height"), F.sum("hits").alias("hits"))
    return merged.select("chamber", "voters", "height", (F.col("hits") / max(replicates, 1)).alias("support"))


# ---------------------------------------------------------------- communities and null models


@dataclass
class Links:
    """A symmetric weight matrix as the links of each node: near[start[v] : start[v + 1]] with their weights, a loop included."""

    start: np.ndarray
    near: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> Links:
        """Of entries (i, j, w), repeated ones summed."""
        code, at = np.unique(i.astype(np.int64) * n + j, return_inverse=True)
        return cls(np.searchsorted(code, np.arange(n + 1, dtype=np.int64) * n), code % n, np.bincount(at, w, len(code)))

    @property
    def ends(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))


def louvain(w: np.ndarray, resolution: float = 1.0, constant: bool = False) -> np.ndarray:
    """``linked_communities`` of a symmetric weight matrix."""
    i, j = np.nonzero(w)
    return linked_communities(Links.of(len(w), i, j, w[i, j].astype(float)), resolution, constant)


def linked_communities(links: Links, resolution: float = 1.0, constant: bool = False) -> np.ndarray:
    """Labels of the communities of a graph, by local moves and folding until nothing gains.

    ``constant`` weighs a pair by 1 in place of its expected weight (the constant Potts model).
    A node looks at its neighbours' communities, its own and an empty one: any other one gains less than the empty one.
    """
    n = len(links.start) - 1
    labels, mass, total = np.arange(n), np.ones(n), links.weight.sum()
    if total <= 0:
        return labels
    while True:
        size = len(links.start) - 1
        own, many = np.arange(size), np.ones(size, int)
        empty: list[int] = []
        pull = mass if constant else np.bincount(links.ends, links.weight, size)
        norm = 1.0 if constant else total
        held = pull.copy()
        moved = True
        while moved:
            moved = False
            for v in range(size):
                at = own[v]
                held[at] -= pull[v]
                many[at] -= 1
                part = slice(links.start[v], links.start[v + 1])
                near, weight = links.near[part], links.weight[part]
                others = near != v
                there, back = np.unique(np.r_[own[near[others]], at], return_inverse=True)
                gain = np.bincount(back[:-1], weight[others], len(there)) - resolution * pull[v] * held[there] / norm
                best = int(np.argmax(gain))
                top, to, mine = gain[best], there[best], gain[back[-1]]
                while empty and many[empty[0]]:
                    heapq.heappop(empty)
                if empty and (top < 0 or (top == 0 and empty[0] < to)):
                    top, to = 0.0, empty[0]
                if top > mine + 1e-12:
                    own[v], moved = to, True
                    if not many[at]:
                        held[at] = 0.0
                        heapq.heappush(empty, at)
                held[own[v]] += pull[v]
                many[own[v]] += 1
        _, own = np.unique(own, return_inverse=True)
        groups = own.max() + 1
        labels = own[labels]
        if groups == size:
            return _by_first(labels)
        links, mass = Links.of(groups, own[links.ends], own[links.near], links.weight), np.bincount(own, mass, groups)


def partition_quality(w: np.ndarray, labels: np.ndarray, resolution: float = 1.0) -> float:
    i, j = np.nonzero(w)
    return linked_quality(Links.of(len(w), i, j, w[i, j].astype(float)), labels, resolution)


def linked_quality(links: Links, labels: np.ndarray, resolution: float = 1.0) -> float:
    """Modularity: the share of the weight inside communities, less what is expected there."""
    total = links.weight.sum()
    if total <= 0:
        return 0.0
    inside = links.weight[labels[links.ends] == labels[links.near]].sum()
    return float((inside - resolution * (np.bincount(labels[links.ends], links.weight) ** 2).sum() / total) / total)


def communities(graph: DataFrame, group: str, resolutions: tuple[float, ...] = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0), constant: bool = False) -> DataFrame:
    """(group, resolution, communities, modularity, voter, community) of edges (group, a, b, weight), each graph and resolution in one task, which holds the edges."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        names, ends = np.unique(np.concatenate([rows["a"], rows["b"]]).astype(str), return_inverse=True)
        i, j, w, r = ends[: len(rows)], ends[len(rows) :], rows["weight"].to_numpy(float), float(rows["resolution"].iloc[0])
        links = Links.of(len(names), np.r_[i, j], np.r_[j, i], np.r_[w, w])
        labels = linked_communities(links, r, constant)
        return pd.DataFrame({"grp": rows["grp"].iloc[0], "resolution": r, "communities": labels.max() + 1, "modularity": linked_quality(links, labels), "voter": names, "community": labels})

    dealt = graph.select(F.col(group).alias("grp"), "a", "b", "weight", F.explode(F.array(*(F.lit(float(r)) for r in resolutions))).alias("resolution"))
    dealt = dealt.repartition(4 * len(resolutions), "grp", "resolution")
    return dealt.groupBy("grp", "resolution").applyInPandas(fit, "grp string, resolution double, communities int, modularity double, voter string, community int").withColumnRenamed("grp", group)


def path_centralities(graph: DataFrame, group: str) -> DataFrame:
    """(group, voter, closeness, harmonic, eigenvector) of edges (group, a, b, weight); an edge is 1 / weight long.

    Closeness is scaled by the share of members that can be reached; the eigenvector is that of the greatest eigenvalue, of length 1.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        names, ends = np.unique(np.concatenate([rows["a"], rows["b"]]).astype(str), return_inverse=True)
        i, j, n = ends[: len(rows)], ends[len(rows) :], len(names)
        w, d = np.zeros((n, n)), np.full((n, n), np.inf)
        w[i, j] = w[j, i] = rows["weight"].to_numpy(float)
        d[w > 0] = 1 / w[w > 0]
        np.fill_diagonal(d, 0)
        for v in range(n):
            d = np.minimum(d, d[:, v, None] + d[v])
        reached = np.isfinite(d).sum(1) - 1
        total = np.where(np.isfinite(d), d, 0).sum(1)
        inverse = 1 / np.where(d > 0, d, np.inf)
        vector = np.abs(np.linalg.eigh(w)[1][:, -1])
        return pd.DataFrame({"grp": rows[group].iloc[0], "voter": names, "closeness": np.where(total > 0, reached / np.where(total > 0, total, 1) * reached / max(n - 1, 1), 0), "harmonic": inverse.sum(1), "eigenvector": vector})

    return graph.groupBy(group).applyInPandas(fit, "grp string, voter string, closeness double, harmonic double, eigenvector double").withColumnRenamed("grp", group)


def degree_model(kr: np.ndarray, nr: np.ndarray, kc: np.ndarray, nc: np.ndarray, rounds: int = 5000) -> np.ndarray:
    """Probabilities of links of the maximum-entropy two-sided graph, by degrees of rows (of which ``nr`` have each) and columns.

    Nodes of equal degree have equal chances, so nothing is held for a node or a pair.
    """
    out = np.zeros((len(kr), len(kc)))
    r, c = np.arange(len(kr)), np.arange(len(kc))
    kr, kc, nr, nc = (np.array(v, float) for v in (kr, kc, nr, nc))
    while len(r) and len(c):  # rows and columns that are empty or full among what is left are certain
        full_r, full_c = kr == nc.sum(), kc == nr.sum()
        sure_r, sure_c = full_r | (kr == 0), full_c | (kc == 0)
        if not sure_r.any() and not sure_c.any():
            break
        if sure_r.any():
            out[np.ix_(r[full_r], c)] = 1.0
            kc = kc - nr[full_r].sum()
            r, kr, nr = r[~sure_r], kr[~sure_r], nr[~sure_r]
        else:
            out[np.ix_(r, c[full_c])] = 1.0
            kr = kr - nc[full_c].sum()
            c, kc, nc = c[~sure_c], kc[~sure_c], nc[~sure_c]
    if not len(r) or not len(c):
        return out
    x, y = kr / math.sqrt(kr @ nr), kc / math.sqrt(kc @ nc)
    for _ in range(rounds):
        x = kr / (nc * y / (1 + np.outer(x, y))).sum(1)
        y = kc / ((nr * x)[:, None] / (1 + np.outer(x, y))).sum(0)
        p = np.outer(x, y)
        p /= 1 + p
        if np.abs(p @ nc - kr).max() < 1e-8:
            break
    out[np.ix_(r, c)] = p
    return out


def configuration_model(rows: np.ndarray, columns: np.ndarray, rounds: int = 5000) -> np.ndarray:
    """``degree_model`` as a table of all nodes of the given degrees."""
    (kr, r, nr), (kc, c, nc) = (np.unique(v, return_inverse=True, return_counts=True) for v in (rows, columns))
    return degree_model(kr, nr, kc, nc, rounds)[np.ix_(r, c)]


def _poisson_tail(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """P(X >= k) for a Poisson X, summed from k on so that small tails keep their digits."""
    k, mean = np.asarray(k, float), np.maximum(np.asarray(mean, float), 1e-300)
    values, at = np.unique(k, return_inverse=True)
    lead = np.exp(k * np.log(mean) - mean - np.array([math.lgamma(v + 1) for v in values])[at])
    total, term, i = lead.copy(), lead.copy(), 1
    while (term > 1e-17 * total).any() and i < 100_000:
        term = term * mean / (k + i)
        total, i = total + term, i + 1
    return np.where(k <= 0, 1.0, np.minimum(total, 1.0))


def null_backbone(coo: DataFrame, members: DataFrame, alpha: float = 0.01, save=written) -> DataFrame:
    """(chamber, a, b, shared, expected, p): pairs of voters with more Yeas in common than the two-sided configuration model explains.

    Chances are Poisson tails about the model's expected count; a missing vote counts as no Yea.
    One task holds a chamber's different degrees and their square, none its voters or items.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha is a chance above 0")

    rows = with_group(coo, members)
    degree = F.sum(F.coalesce("y", F.lit(0.0))).cast("long").alias("k")
    voters, items = save(rows.groupBy("chamber", "voter").agg(degree)), rows.groupBy("chamber", "item").agg(degree)
    counted = lambda df, side: df.groupBy("chamber", "k").agg(F.count("*").alias("n")).withColumn("side", F.lit(side))

    def fit(degrees: pd.DataFrame) -> pd.DataFrame:
        (kr, nr), (kc, nc) = (degrees[degrees["side"] == side].sort_values("k")[["k", "n"]].to_numpy().T for side in ("voter", "item"))
        p = degree_model(kr, nr, kc, nc)
        i, j = np.triu_indices(len(kr))
        return pd.DataFrame({"chamber": degrees["chamber"].iloc[0], "low": kr[i], "high": kr[j], "expected": ((p * nc) @ p.T)[i, j]})

    expected = counted(voters, "voter").unionByName(counted(items, "item")).groupBy("chamber").applyInPandas(fit, "chamber string, low long, high long, expected double")

    @F.pandas_udf("double")
    def tail(shared: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series(_poisson_tail(shared.to_numpy(), mean.to_numpy()))

    # voters without a common Yea have a chance of 1
    yea = rows.where("y = 1").select(F.struct("chamber", "item").alias("place"), F.struct("chamber", "voter").alias("key"))
    met = meetings(yea, "place", "key", F.lit(1), 1, (), save=save).select(F.col("a.chamber").alias("chamber"), F.col("a.voter").alias("a"), F.col("b.voter").alias("b"), F.col("n").alias("shared"))
    for end in ("a", "b"):
        met = met.join(voters.select("chamber", F.col("voter").alias(end), F.col("k").alias(f"k{end}")), ["chamber", end])
    met = met.withColumns({"low": F.least("ka", "kb"), "high": F.greatest("ka", "kb")}).join(expected, ["chamber", "low", "high"])
    return met.withColumn("p", tail("shared", "expected")).where(F.col("p") < alpha).select("chamber", "a", "b", "shared", "expected", "p")
