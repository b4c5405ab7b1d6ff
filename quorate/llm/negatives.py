"""Hard-negative mining: for every anchor and each of its positives, the nearest rows of other labels in a score band.

Vectors are quantised to integers, ``floor(scale * x)``, and the score of a row is its integer inner product
with the anchor, so that results are exact and the same on every machine.  Higher scores come first,
ties by the smaller id.  An anchor's positives are its first ``positives`` other rows of the same label; the negatives
of a positive are the first ``negatives`` rows of another label whose score lies between ``low`` per cent of
the positive's score and that score.

Method.  Anchors and rows are dealt in blocks, of which each two meet in one group.  There every anchor's
scores are sorted whole, by score and id.  A first pass reads each anchor's best rows of its own label from
that order.  A second one takes the rows of other labels, finds each positive's upper limit by binary search and reads on from
there until there are enough or the lower limit is passed.  What blocks find is merged by a
limited rank: Spark keeps the best of each task before it shuffles.  Blocks are dealt by a hash of the whole row, so
neither a frequent label nor a repeated vector fills one of them.

Defined results: rows without id, label or vector, with another length than the commonest, or with a null
or non-finite component take no part; zero vectors do.  Fully repeated rows count once; an id that stands on
several rows is a row each time, and never its own positive or negative.  Components and
scores beyond 64 bits count as the nearest limit.  An anchor without positives, and
a positive without rows in its band, give no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows and anchors of a block.
ROWS = 8192
ANCHORS = 2048
#: Scores that are sorted at a time.
SCORES = 1 << 21
#: Largest absolute score.
LIMIT = (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, q array<long>, token) of the rows that take part, without repeats."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (sizes["n"] if sizes else -1))
    rows = rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("q")).dropDuplicates(["vec_id", "label", "q"])
    return rows.withColumn("token", F.xxhash64("vec_id", "label", "q"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows: as doubles where all sums stay below 2**53, else as Python numbers held to 64 bits."""
    top = [max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) for x in (a, b)]
    if top[0] * top[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -LIMIT, LIMIT).astype(np.int64)


def in_order(left: pa.Table, right: pa.Table):
    """For each anchor of ``left``: (its place, ids, labels and scores of ``right`` by falling score, then id)."""
    right = right.sort_by("vec_id")
    a, b = _matrix(left.column("anchor")), _matrix(right.column("q"))
    ids, labels = right.column("vec_id").to_numpy(), right.column("label").to_numpy()
    step = max(1, SCORES // max(1, len(b)))
    for lo in range(0, len(a), step):
        scores = products(a[lo : lo + step], b)
        order = np.argsort(-scores, axis=1, kind="stable")  # ids rise already, so ties stay in their order
        for k in range(len(scores)):
            yield lo + k, ids[order[k]], labels[order[k]], scores[k, order[k]]


def best_positives(left: pa.Table, right: pa.Table, positives: int) -> pa.Table:
    """(token, positive_id, positive_score): each anchor's first rows of its own label in this block."""
    own, label, token = (left.column(c).to_numpy() for c in ("anchor_id", "anchor_label", "token"))
    out = []
    for k, ids, labels, scores in in_order(left, right):
        at = np.flatnonzero((labels == label[k]) & (ids != own[k]))[:positives]
        out += [(int(token[k]), int(ids[i]), int(scores[i])) for i in at]
    return _table(out, ["token", "positive_id", "positive_score"])


def band_negatives(left: pa.Table, right: pa.Table, negatives: int, low: int) -> pa.Table:
    """(token, positive_id, negative_id, negative_score): the first rows of other labels in each positive's band in this block."""
    own, label, token = (left.column(c).to_numpy() for c in ("anchor_id", "anchor_label", "token"))
    wanted = left.column("positives").to_pylist()
    out = []
    for k, ids, labels, scores in in_order(left, right):
        other = np.flatnonzero((labels != label[k]) & (ids != own[k]))
        ids, scores = ids[other], scores[other]
        falling = -scores
        for positive in wanted[k]:
            upper = positive["positive_score"]
            lower = -(-low * upper // 100)
            at = int(np.searchsorted(falling, -upper))
            for i in range(at, min(at + negatives, len(ids))):
                if scores[i] < lower:
                    break
                out.append((int(token[k]), positive["positive_id"], int(ids[i]), int(scores[i])))
    return _table(out, ["token", "positive_id", "negative_id", "negative_score"])


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchors`` is a condition on vec_id."""
    spark = vectors.sparkSession
    rows = common.materialise(quantised(vectors, id_col, vector_col, F.col("label") if label is None else label, scale), "quantised")
    asked = rows.where(anchors).select(F.col("token"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("q").alias("anchor"))
    n, m = rows.count(), asked.count()
    if not m:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    row_blocks, anchor_blocks = -(-n // ROWS), -(-m // ANCHORS)

    def each(block: str, other: str, blocks: int, others: int):
        return F.pmod(F.xxhash64("token"), F.lit(blocks)).cast("int").alias(block), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)

    entries = rows.select(*each("e", "q_", row_blocks, anchor_blocks), "vec_id", "label", "q")

    def met(left: DataFrame, kernel, schema: str) -> DataFrame:
        def run(one: pa.Table, other: pa.Table) -> pa.Table:
            return kernel(one, other)

        return left.groupBy("e", "q_").cogroup(entries.groupBy("e", "q_")).applyInArrow(run, schema)

    placed = asked.select(*each("q_", "e", anchor_blocks, row_blocks), "token", "anchor_id", "anchor_label", "anchor")
    found = met(placed, lambda one, other: best_positives(one, other, positives), "token long, positive_id long, positive_score long")
    best = Window.partitionBy("token").orderBy(F.desc("positive_score"), "positive_id")
    first = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    first = common.materialise(first.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives")), "positives")

    again = placed.join(first, "token").select("q_", "e", "token", "anchor_id", "anchor_label", "anchor", "positives")
    near = met(again, lambda one, other: band_negatives(one, other, negatives, low), "token long, positive_id long, negative_id long, negative_score long")
    best = Window.partitionBy("token", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = asked.select("token", "anchor_id").join(first, "token").select("token", "anchor_id", F.explode("positives").alias("p"))
    named = named.select("token", "anchor_id", F.col("p.positive_id").alias("positive_id"), F.col("p.positive_score").alias("positive_score"))
    return named.join(near, ["token", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12(spark, sf_dir: str) -> DataFrame:
    rows = common.read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 100 == 0, label=label)


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""
