"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed byte trigrams, scaled by the classes' log-count ratio and brought
to unit length; a linear hinge-loss model over them is fitted by dual coordinate descent.  Margins
become probabilities by a logistic fit on margins of rows that the model hadn't seen (two folds).

The model is fitted on the driver on a bounded sample of labelled rows (``SAMPLE`` rows); scoring always
takes every whole text.

Defined results: null texts are empty and get the score of a text without n-grams; null ids and
repeated rows each get a row; without labels of both classes every score is the share of label 1,
or 0.5 without labels; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, ngrams

#: Labelled rows that the model is fitted on, at most about.
SAMPLE = 6000
BITS = 18
_TABLE = ngrams.byte_map(letters_only=False)


@dataclass
class Model:
    """margin(x) = weights . x / |ratio of x's n-grams| + bias; probability by a logistic curve."""

    weights: np.ndarray  # weight times ratio, per bucket
    squares: np.ndarray  # ratio squared, per bucket
    bias: float
    slope: float
    shift: float

    def margins(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        length = np.sqrt(np.maximum(ngrams.row_sums(self.squares[codes], bounds), 1e-12))
        return ngrams.row_sums(self.weights[codes], bounds) / length + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def log_count_ratio(codes: np.ndarray, bounds: np.ndarray, y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    row_y = np.repeat(y, np.diff(bounds))
    p = np.bincount(codes[row_y > 0], minlength=1 << BITS) + smooth
    q = np.bincount(codes[row_y <= 0], minlength=1 << BITS) + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """min |w|^2/2 + sum cost * hinge, over sparse rows (indices, values) of unit length and a constant feature."""
    w, bias, alpha, rng = np.zeros(1 << BITS), 0.0, np.zeros(len(x)), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            at, v = x[i]
            gradient = y[i] * (w[at] @ v + bias) - 1
            fresh = min(max(alpha[i] - gradient / (1 + float(v @ v)), 0.0), cost[i])
            if step := (fresh - alpha[i]) * y[i]:
                w[at] += step * v
                bias += step
                alpha[i] = fresh
    return w, bias


def fit_rows(codes: np.ndarray, bounds: np.ndarray, y: np.ndarray, c: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    ratio = log_count_ratio(codes, bounds, y)
    rows = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        v = ratio[codes[a:b]]
        rows.append((codes[a:b], v / max(float(np.sqrt(v @ v)), 1e-6)))
    # both classes weigh the same in the hinge loss; the logistic curve brings back their true shares
    cost = np.where(y > 0, c * len(y) / max(1, 2 * (y > 0).sum()), c * len(y) / max(1, 2 * (y <= 0).sum()))
    w, bias = dual_coordinate_descent(rows, y, cost)
    return w * ratio, ratio**2, bias


def logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of P(y = 1 | margin), by Newton steps with a little ridge on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([margin, np.ones_like(margin)], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (t - p) - 1e-6 * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _rows(codes, bounds, chosen):
    sizes = np.diff(bounds)[chosen]
    return codes[common.gather_ranges(bounds[:-1][chosen], sizes)], np.r_[0, np.cumsum(sizes)]


def fit(codes: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> Model | float:
    """A model, or the share of label 1 if the labels don't hold both classes twice."""
    if min((y > 0).sum(), (y <= 0).sum()) < 2:
        return float((y > 0).mean()) if len(y) else 0.5
    fold = np.zeros(len(y), dtype=int)
    for side in (y > 0, y <= 0):
        fold[side] = np.arange(side.sum()) % 2
    margin = np.zeros(len(y))
    for k in (0, 1):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        part = Model(*fit_rows(*_rows(codes, bounds, train), y[train]), 1, 0)
        margin[test] = part.margins(*_rows(codes, bounds, test))
    return Model(*fit_rows(codes, bounds, y), *logistic(margin, y))


def features(rows: DataFrame) -> DataFrame:
    """(key, y, codes): the distinct n-gram buckets of each text, as the fitting sample."""

    @common.tidy
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, codes, bounds in ngrams.coded(batch.column("text"), _TABLE, BITS):
                codes, bounds = ngrams.distinct_in_rows(codes, bounds, BITS)
                n = len(bounds) - 1
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(codes.astype(np.int32)))
                yield pa.record_batch([batch.column("key").slice(lo, n), batch.column("y").slice(lo, n), lists], names=["key", "y", "codes"])

    return rows.mapInArrow(grams, "key long, y int, codes array<int>")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 4, remainder: int = 2, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels are taken only from ids whose crc32 of the decimal text, mod ``modulus``, isn't ``remainder``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = labels.select(F.col(id_col).cast("long").alias("key"), F.col(label_col).cast("int").alias("y")).where("key is not null and y is not null")
    marked = marked.where(~common.held_out_column("key", modulus, remainder)).groupBy("key").agg(F.max("y").alias("y"))
    # the sample takes both classes at the same rate, by a hash of the id
    rate = min(1.0, SAMPLE / max(1, marked.count()))
    chosen = common.materialise(marked.where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < int(rate * (1 << 40))), "labels")
    # of rows that repeat an id one is learnt from
    first = Window.partitionBy("key").orderBy(F.xxhash64("text"))
    learnt = rows.join(chosen, F.col("doc_id") == F.col("key")).select("key", "y", "text").withColumn("i", F.row_number().over(first)).where("i = 1")
    sample = features(learnt.select("key", "y", "text")).orderBy("key").toArrow()
    y = np.where(sample.column("y").to_numpy() > 0, 1.0, -1.0) if sample.num_rows else np.zeros(0)
    lists = sample.column("codes").combine_chunks()
    sizes = np.fromiter((len(x) for x in lists), dtype=np.int64, count=len(lists)) if len(lists) else np.zeros(0, np.int64)
    codes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    model = spark.sparkContext.broadcast(fit(codes, np.r_[0, np.cumsum(sizes)], y))  # two arrays of 2**BITS numbers

    @common.tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            out = np.full(batch.num_rows, m if isinstance(m, float) else 0.5)
            if not isinstance(m, float):
                for lo, codes, bounds in ngrams.coded(batch.column("text"), _TABLE, BITS):
                    codes, bounds = ngrams.distinct_in_rows(codes, bounds, BITS)
                    out[lo : lo + len(bounds) - 1] = m.probability(m.margins(codes, bounds))
            ids = batch.column("doc_id")
            held = common.held_out_flags(ids.to_pylist(), modulus, remainder)
            yield pa.record_batch([ids, pa.array(held, pa.bool_()), pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op4(spark, sf_dir: str) -> DataFrame:
    return classify(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))
