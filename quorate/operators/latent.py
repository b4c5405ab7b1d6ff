"""Latent positions: principal components, two-parameter items, latent classes, clusters.

The kernels run on NumPy for one chamber at a time, on its known cells.  Posterior sampling is
replaced by maximum a posteriori estimates with Laplace standard deviations; results carry that
name and no claim of full posteriors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sparse_votes import Cells, Standard, by_chamber
from .sweeps import Block, Dealt, large


def _matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(voters x items with NaN, voters, items)."""
    voters, i = np.unique(rows["voter"].to_numpy(str), return_inverse=True)
    items, j = np.unique(rows["item"].to_numpy(), return_inverse=True)
    m = np.full((len(voters), len(items)), np.nan)
    m[i, j] = rows["y"].to_numpy(float)
    return m, voters, items


def with_group(coo: DataFrame, members: DataFrame) -> DataFrame:
    return coo.join(members.select("voter", "chamber", "party"), "voter").select("chamber", "voter", "party", "item", F.col("y").cast("double").alias("y"))


def principal_components(coo: DataFrame, members: DataFrame, k: int = 2) -> DataFrame:
    """(chamber, voter, component, score, explained); Republicans have the greater mean on the first."""

    def fit(c: Cells) -> pd.DataFrame:
        u, s, share = Standard(c).components(k)
        score = u * s
        one = c.party == "Republican"
        if one.any() and (~one).any() and score[one, 0].mean() < score[~one, 0].mean():
            score[:, 0] *= -1
        return pd.concat([pd.DataFrame({"chamber": c.chamber, "voter": c.voters, "component": t + 1, "score": score[:, t], "explained": share[t]}) for t in range(score.shape[1])])

    rows, schema = with_group(coo, members), "chamber string, voter string, component int, score double, explained double"
    if not large(rows):
        return by_chamber(rows, fit, schema)
    dealt = Dealt(rows)
    found = {}
    for c, (u, s, share) in dealt.components(k).items():
        score, one = u * s, dealt.sides[c]
        if one.any() and (~one).any() and score[one, 0].mean() < score[~one, 0].mean():
            score[:, 0] *= -1
        found[c] = score, share
    told = lambda c, code, score, share: [{"component": np.full(len(code), t + 1), "score": score[code, t], "explained": np.full(len(code), share[t])} for t in range(score.shape[1])]
    return dealt.by_voter(found, told, schema)


def ideal_points(coo: DataFrame, members: DataFrame, rounds: int = 60) -> DataFrame:
    """Maximum a posteriori two-parameter logistic positions with Laplace deviations.

    (chamber, kind, key, first, second): voters have position and deviation, items ease and discrimination.
    """

    def fit(c: Cells) -> pd.DataFrame:
        i, j, y, n, p = c.i, c.j, c.y, len(c.voters), len(c.items)
        one = c.party == "Republican"
        xi = np.where(one, 0.5, -0.5) + 0.01 * np.arange(n) / n
        a, b = np.zeros(p), np.zeros(p)
        for _ in range(rounds):
            for _ in range(2):  # items given voters
                x = xi[i]
                q = 1 / (1 + np.exp(-(a[j] + x * b[j])))
                r, w = y - q, q * (1 - q)
                ga, gb = np.bincount(j, r, p) - a / 9, np.bincount(j, r * x, p) - b
                haa, hab, hbb = np.bincount(j, w, p) + 1 / 9, np.bincount(j, w * x, p), np.bincount(j, w * x**2, p) + 1
                det = haa * hbb - hab**2
                a, b = a + np.clip((hbb * ga - hab * gb) / det, -1, 1), b + np.clip((haa * gb - hab * ga) / det, -1, 1)
            slope = b[j]
            q = 1 / (1 + np.exp(-(a[j] + xi[i] * slope)))
            h = np.bincount(i, q * (1 - q) * slope**2, n) + 1
            xi = xi + np.clip((np.bincount(i, (y - q) * slope, n) - xi) / h, -1, 1)
            xi = (xi - xi.mean()) / max(xi.std(), 1e-9)
        if one.any() and (~one).any() and xi[one].mean() < xi[~one].mean():
            xi, b = -xi, -b
        return pd.concat([pd.DataFrame({"chamber": c.chamber, "kind": "voter", "key": c.voters, "first": xi, "second": 1 / np.sqrt(h)}), pd.DataFrame({"chamber": c.chamber, "kind": "item", "key": c.items.astype(str), "first": a, "second": b})])

    return by_chamber(with_group(coo, members), fit, "chamber string, kind string, key string, first double, second double")


def latent_classes(coo: DataFrame, members: DataFrame, most: int = 4, rounds: int = 80, seed: int = 11) -> DataFrame:
    """(chamber, classes, bic, voter, class, probability): Bernoulli mixtures by EM, the size of the least BIC."""

    def fit(c: Cells) -> pd.DataFrame:
        i, j, y, n, p = c.i, c.j, c.y, len(c.voters), len(c.items)
        rng, best = np.random.default_rng(seed), None
        for k in range(1, most + 1):
            post = rng.dirichlet(np.ones(k), n)
            for _ in range(rounds):
                pi = (post.sum(0) + 1) / (n + k)
                log = np.empty((n, k))
                for g in range(k):
                    weight = post[i, g]
                    yes = (np.bincount(j, weight * y, p) + 1) / (np.bincount(j, weight, p) + 2)
                    log[:, g] = np.log(pi[g]) + np.bincount(i, np.where(y == 1, np.log(yes)[j], np.log(1 - yes)[j]), n)
                top = log.max(1, keepdims=True)
                like = top[:, 0] + np.log(np.exp(log - top).sum(1))
                post = np.exp(log - like[:, None])
            bic = -2 * like.sum() + (k - 1 + k * p) * np.log(n)
            if best is None or bic < best[0]:
                best = (bic, k, post)
        bic, k, post = best
        return pd.DataFrame({"chamber": c.chamber, "classes": k, "bic": bic, "voter": c.voters, "class": post.argmax(1), "probability": post.max(1)})

    rows, schema = with_group(coo, members), "chamber string, classes int, bic double, voter string, class int, probability double"
    return _dealt_classes(Dealt(rows), most, rounds, seed, schema) if large(rows) else by_chamber(rows, fit, schema)


def _dealt_classes(dealt: Dealt, most: int, rounds: int, seed: int, schema: str) -> DataFrame:
    """``latent_classes`` with a sweep a round, in which all sizes go together."""

    def add(block: Block, fill: np.ndarray, post: np.ndarray) -> np.ndarray:
        n, p, yea = len(fill), len(block.lens), block.y == 1
        iy, jy, out = block.i[yea], block.j[yea], np.empty(post.shape)
        for g in range(post.shape[1]):
            weight = np.ascontiguousarray(post[:, g])
            cell = weight[block.i]
            yes = (np.bincount(block.j, cell * block.y, p) + 1) / (np.bincount(block.j, cell, p) + 2)
            nay = np.log(1 - yes)
            out[:, g] = np.bincount(block.i, nay[block.j], n) + np.bincount(iy, (np.log(yes) - nay)[jy], n)
        return out

    sizes = range(1, most + 1)
    groups = [slice(k * (k - 1) // 2, k * (k + 1) // 2) for k in sizes]
    post = {}
    for c, fill in dealt.fill.items():
        rng = np.random.default_rng(seed)
        post[c] = np.hstack([rng.dirichlet(np.ones(k), len(fill)) for k in sizes])
    for _ in range(rounds):
        told, like = dealt.sums(add, post), {}
        for c, log in told.items():
            n, parts, sums = len(log), [], []
            for k, at in zip(sizes, groups, strict=True):
                mine = log[:, at] + np.log((post[c][:, at].sum(0) + 1) / (n + k))
                top = mine.max(1, keepdims=True)
                sums.append(top[:, 0] + np.log(np.exp(mine - top).sum(1)))
                parts.append(np.exp(mine - sums[-1][:, None]))
            post[c], like[c] = np.hstack(parts), [x.sum() for x in sums]
    found = {}
    for c, likes in like.items():
        bics = [-2 * x + (k - 1 + k * dealt.items[c]) * np.log(len(dealt.fill[c])) for k, x in zip(sizes, likes, strict=True)]
        best = int(np.argmin(bics))
        found[c] = sizes[best], bics[best], post[c][:, groups[best]]
    told = lambda c, code, k, bic, post: [{"classes": np.full(len(code), k), "bic": np.full(len(code), bic), "class": post[code].argmax(1), "probability": post[code].max(1)}]
    return dealt.by_voter(found, told, schema)


def clusters(vectors: DataFrame, k: int = 8, seed: int = 3) -> DataFrame:
    """(vec_id, label, cluster) by k-means over embeddings."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20, predictionCol="cluster").fit(rows).transform(rows).drop("features")


def draws_summary(draws: DataFrame) -> DataFrame:
    """Mean, deviation, 95 % interval and split R-hat of each parameter in a table (param, chain, draw, value)."""
    half = F.percent_rank().over(Window.partitionBy("param", "chain").orderBy("draw")) >= 0.5
    parts = draws.withColumn("half", half.cast("int"))
    by = parts.groupBy("param", "chain", "half").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    r = by.groupBy("param").agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.avg("n").alias("n"))
    r = r.select("param", F.sqrt(F.try_divide((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b"), F.col("w"))).alias("rhat"))
    out = draws.groupBy("param").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"))
    return out.join(r, "param")
