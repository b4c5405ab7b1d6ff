"""Weighted graphs as edge tables (a, b, weight) with a < b."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.files import written
from .meetings import meetings


def edges(paired: DataFrame, threshold: float, measure: str = "kappa") -> DataFrame:
    return paired.where(F.col(measure) > threshold).select("a", "b", F.col(measure).alias("weight"))


def doubled(graph: DataFrame) -> DataFrame:
    return graph.select("a", "b", "weight").unionAll(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def degrees(graph: DataFrame) -> DataFrame:
    return doubled(graph).groupBy(F.col("a").alias("voter")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def triangles(graph: DataFrame) -> DataFrame:
    """Triangles at each node: edges ordered by node, so each triangle is met once."""
    e = graph.select("a", "b")
    wedge = e.alias("x").join(e.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("x.b").alias("m"), F.col("y.b").alias("b"))
    closed = wedge.join(e, ["a", "b"])
    return closed.select(F.explode(F.array("a", "m", "b")).alias("voter")).groupBy("voter").agg(F.count("*").alias("triangles"))


def local_clustering(graph: DataFrame) -> DataFrame:
    out = degrees(graph).join(triangles(graph), "voter", "left").fillna({"triangles": 0})
    return out.withColumn("clustering", F.coalesce(ratio(2 * F.col("triangles"), F.col("degree") * (F.col("degree") - 1)), F.lit(0.0))).select("voter", "degree", "triangles", "clustering")


def summary(graph: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes with an edge, edges, density, mean weight, transitivity and the share of edges inside a party.

    The edges are read five times, so they are written once.
    """
    graph = written(graph)
    local = local_clustering(graph).agg(F.count("*").alias("nodes"), F.avg("clustering").alias("mean_clustering"), ratio(F.sum("triangles"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2)).alias("transitivity"))
    p = members.select("voter", "party")
    tied = graph.join(p.toDF("a", "pa"), "a").join(p.toDF("b", "pb"), "b").agg(F.count("*").alias("edges"), F.avg("weight").alias("mean_weight"), F.avg((F.col("pa") == F.col("pb")).cast("int")).alias("same_party"))
    return local.join(tied).withColumn("density", ratio(2 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)))


def modularity(graph: DataFrame, groups: DataFrame) -> DataFrame:
    """Weighted modularity of a partition (voter, party)."""
    g = groups.select("voter", "party")
    ends = doubled(graph).join(g.toDF("a", "pa"), "a").join(g.toDF("b", "pb"), "b")
    total = ends.agg(F.sum("weight").alias("m2"))
    by = ends.groupBy("pa").agg(F.sum("weight").alias("tot"), F.sum(F.when(F.col("pa") == F.col("pb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    return by.join(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("m2") - (F.col("tot") / F.col("m2")) ** 2).alias("modularity"), F.count("*").alias("groups"))


def cross_party(graph: DataFrame, members: DataFrame) -> DataFrame:
    p = members.select("voter", "party")
    ends = doubled(graph).join(p.toDF("a", "pa"), "a").join(p.toDF("b", "pb"), "b")
    return ends.groupBy(F.col("a").alias("voter")).agg(F.count("*").alias("edges"), F.count(F.when(F.col("pa") != F.col("pb"), 1)).alias("crossing")).withColumn("share", ratio(F.col("crossing"), F.col("edges")))


def disparity(graph: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Edges that are significant at either end; a node's only edge stays."""
    d = degrees(graph)
    rows = graph.join(d.toDF("a", "ka", "sa"), "a").join(d.toDF("b", "kb", "sb"), "b")
    chance = lambda k, s: F.when(F.col(k) == 1, 0.0).otherwise(F.pow(1 - F.col("weight") / F.col(s), F.col(k) - 1))
    return rows.withColumn("chance", F.least(chance("ka", "sa"), chance("kb", "sb"))).where(F.col("chance") < alpha).select("a", "b", "weight", "chance")


def components(graph: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(voter, component): the smallest voter reachable; ``save`` cuts the lineage of each round.  Rounds go on until nothing moves."""
    near = doubled(graph).select("a", "b")
    now = save(near.select(F.col("a").alias("voter")).distinct().withColumn("component", F.col("voter")))
    while True:
        best = near.join(now.select(F.col("voter").alias("b"), "component"), "b").groupBy(F.col("a").alias("voter")).agg(F.min("component").alias("least"))
        step = now.join(best, "voter").select("voter", F.least("component", "least").alias("fresh"), "component")
        # a component points to a smaller one of its own as soon as any of its members does
        jump = step.groupBy("component").agg(F.min("fresh").alias("jump"))
        after = save(step.join(jump, "component").select("voter", F.least("fresh", "jump").alias("component"), (F.col("component") != F.least("fresh", "jump")).alias("moved")))
        now = after.select("voter", "component")
        if after.where("moved").isEmpty():
            return now


def pagerank(graph: DataFrame, save: Callable[[DataFrame], DataFrame], rounds: int = 20, damping: float = 0.85) -> DataFrame:
    ends = doubled(graph)
    out = ends.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("a"))).select("a", "b", "share")
    n = degrees(graph).count()
    rank = degrees(graph).select("voter", F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(rounds):
        got = out.join(rank, F.col("a") == F.col("voter")).groupBy("b").agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        rank = got.select(F.col("b").alias("voter"), ((1 - damping) / max(n, 1) + damping * F.col("got")).alias("rank"))
        if i % 5 == 4:
            rank = save(rank)
    return rank


def threshold_sweep(paired: DataFrame, thresholds: list[float]) -> DataFrame:
    """Edges and nodes left at each threshold, in one pass."""
    kept = paired.withColumn("threshold", F.explode(F.filter(F.array(*(F.lit(t) for t in thresholds)), lambda t: F.col("kappa") > t)))
    nodes = kept.select("threshold", F.explode(F.array("a", "b")).alias("voter")).groupBy("threshold").agg(F.countDistinct("voter").alias("nodes"))
    return kept.groupBy("threshold").agg(F.count("*").alias("edges"), F.avg("kappa").alias("mean_kappa")).join(nodes, "threshold")


def projection(coo: DataFrame, least: float = 0.0, voters: int = 1) -> DataFrame:
    """Items tied by ``voters`` common Yea voters or more, each voter's ties weighing 1 / (own Yeas - 1)."""
    yea = coo.where("y = 1").withColumn("k", F.count("*").over(Window.partitionBy("voter"))).where("k > 1")
    met = meetings(yea, "voter", "item", 1 / (F.col("k") - 1), voters, ("sa",), binary=False)
    return met.select("a", "b", F.col("sa").alias("weight"), F.col("n").alias("voters")).where(F.col("weight") > least)


def compare(one: DataFrame, two: DataFrame) -> DataFrame:
    """Edges in both, in one only, and their Jaccard index."""
    both = one.select("a", "b", F.lit(1).alias("x")).join(two.select("a", "b", F.lit(1).alias("z")), ["a", "b"], "full")
    out = both.agg(F.count(F.when(F.col("x").isNotNull() & F.col("z").isNotNull(), 1)).alias("shared"), F.count(F.when(F.col("z").isNull(), 1)).alias("first_only"), F.count(F.when(F.col("x").isNull(), 1)).alias("second_only"))
    return out.withColumn("jaccard", ratio(F.col("shared"), F.col("shared") + F.col("first_only") + F.col("second_only")))


def betweenness(graph: DataFrame, group: str = "chamber") -> DataFrame:
    """Shortest-path betweenness (edge length 1 / weight) inside each group of a graph (group, a, b, weight).

    Exact and cubic in a group's nodes: meant for legislatures of some hundreds.
    """

    def brandes(rows: pd.DataFrame) -> pd.DataFrame:
        import heapq

        names = sorted(set(rows["a"]) | set(rows["b"]))
        place = {v: i for i, v in enumerate(names)}
        near: list[list[tuple[int, float]]] = [[] for _ in names]
        for a, b, w in zip(rows["a"], rows["b"], rows["weight"], strict=True):
            near[place[a]].append((place[b], 1 / w))
            near[place[b]].append((place[a], 1 / w))
        total = np.zeros(len(names))
        for s in range(len(names)):
            dist, paths, before, order = {s: 0.0}, np.zeros(len(names)), [[] for _ in names], []
            paths[s], heap, done = 1, [(0.0, s)], set()
            while heap:
                d, v = heapq.heappop(heap)
                if v in done:
                    continue
                done.add(v)
                order.append(v)
                for u, w in near[v]:
                    if u not in dist or d + w < dist[u] - 1e-12:
                        dist[u], paths[u], before[u] = d + w, paths[v], [v]
                        heapq.heappush(heap, (d + w, u))
                    elif abs(d + w - dist[u]) <= 1e-12 and u not in done:
                        paths[u] += paths[v]
                        before[u].append(v)
            load = np.zeros(len(names))
            for v in reversed(order):
                for u in before[v]:
                    load[u] += paths[u] / paths[v] * (1 + load[v])
                if v != s:
                    total[v] += load[v]
        n = len(names)
        scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
        return pd.DataFrame({"grp": rows[group].iloc[0], "voter": names, "betweenness": total * scale})

    return graph.groupBy(group).applyInPandas(brandes, "grp string, voter string, betweenness double").withColumnRenamed("grp", group)
