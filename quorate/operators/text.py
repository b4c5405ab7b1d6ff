"""Text measures: preprocessing, n-gram containment, best versions, TF-IDF, embedding similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from . import blocks

#: Vectors of a block, at most, and of a tile of a task's matrix.
BLOCK, TILE = 16_384, 1024
#: Rounding that a product of matrices may carry.
SLACK = 1e-9


def clean(text: Column) -> Column:
    """Lower case, letters only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))


def words(text: Column) -> Column:
    cleaned = clean(text)
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def lengths(docs: DataFrame) -> DataFrame:
    rows = docs.select("lang", F.length("text").alias("chars"), F.size(words(F.col("text"))).alias("words"))
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.avg("chars").alias("mean_chars"), F.median("words").alias("median_words"), F.max("words").alias("most_words"))


def ngrams(df: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """(key, gram): distinct word n-grams."""
    tokens = df.select(key, words(F.col(text)).alias("w")).where(F.size("w") >= n)
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.concat_ws(" ", F.slice("w", i + 1, n)))
    return tokens.select(key, F.explode(F.array_distinct(grams)).alias("gram"))


def containment(docs: DataFrame, models: DataFrame, n: int = 5, tiers=((0.7, "near-identical"), (0.4, "strong"), (0.1, "partial"))) -> DataFrame:
    """Share of each model text's n-grams that a document holds, by tiers; pairs below the last tier are left out."""
    d, m = ngrams(docs, "doc_id", "text", n), ngrams(models, "item_id", "text", n)
    size = m.groupBy("item_id").agg(F.count("*").alias("grams"))
    out = m.join(d, "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared")).join(size, "item_id").withColumn("containment", ratio(F.col("shared"), F.col("grams")))
    tier = None
    for low, name in tiers:
        tier = F.when(F.col("containment") >= low, name) if tier is None else tier.when(F.col("containment") >= low, name)
    return out.withColumn("tier", tier).where("tier is not null")


def best_version(docs: DataFrame, group: str, prefer: list[str], kind: str) -> DataFrame:
    """One row per group: the kind preferred most, then the longest text, then the smallest id."""
    place = F.coalesce(F.array_position(F.array(*(F.lit(p) for p in prefer)), F.col(kind)), F.lit(0))
    order = Window.partitionBy(group).orderBy(F.when(place == 0, 10**6).otherwise(place), F.desc(F.length("text")), "doc_id")
    return docs.withColumn("__i", F.row_number().over(order)).where("__i = 1").drop("__i")


def term_weights(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """(doc_id, term, tf, weight): term counts times smoothed inverse document frequency."""
    counts = docs.select("doc_id", F.explode(words(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    frequency = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_docs)
    total = docs.agg(F.count("*").alias("total"))
    weighted = counts.join(frequency, "term").join(F.broadcast(total))
    return weighted.select("doc_id", "term", "tf", (F.col("tf") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1)).alias("weight"))


def top_terms(weights: DataFrame, docs: DataFrame, group: str, k: int = 10) -> DataFrame:
    """Each group's terms of the greatest summed weight."""
    sums = weights.join(docs.select("doc_id", group), "doc_id").groupBy(group, "term").agg(F.sum("weight").alias("weight"))
    order = Window.partitionBy(group).orderBy(F.desc(F.round("weight", 6)), "term")
    return sums.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def normalised(vectors: DataFrame) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return vectors.select("vec_id", "label", F.transform(x, lambda v: F.try_divide(v, norm)).alias("x"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _similar(least: float):
    """Finds the pairs of two blocks of vectors: products of matrices point to them, sums term by term as in ``dot`` decide."""

    def similar_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        label, same = table.column("label")[0], table.column("one")[0].equals(table.column("two")[0])
        ids, types_ = table.column("vec_id").combine_chunks(), [table.schema.field(n).type for n in ("label", "vec_id")]
        key, side = ids.to_numpy(zero_copy_only=False), table.column("side").to_numpy()
        rows = table.column("embedding").combine_chunks()
        flat, starts, lengths = rows.flatten().to_numpy(zero_copy_only=False), rows.offsets.to_numpy() - rows.offsets[0].as_py(), pa.compute.list_value_length(rows).to_numpy()
        for size in np.unique(lengths):  # vectors of different lengths have no product
            at = np.flatnonzero(lengths == size)
            x = flat[starts[at][:, None] + np.arange(size)[None, :]].astype(np.float64)
            norm = np.zeros(len(at))
            with np.errstate(invalid="ignore", over="ignore"):
                for d in range(size):  # in the order of ``normalised``
                    norm += x[:, d] * x[:, d]
                some = norm != 0
                at, x = at[some], x[some] / np.sqrt(norm[some])[:, None]
            first = np.flatnonzero(side[at] == 0)
            second = first if same else np.flatnonzero(side[at] == 1)
            for p in range(0, len(first), TILE):
                for q in range(p if same else 0, len(second), TILE):
                    one, two = first[p : p + TILE], second[q : q + TILE]
                    with np.errstate(invalid="ignore"):
                        i, j = np.nonzero(~(x[one] @ x[two].T < least - SLACK))  # what is no number counts as the greatest, as in Spark
                        i, j = one[i], two[j]
                        if same and p == q:
                            i, j = i[i < j], j[i < j]
                        cosine = np.zeros(len(i))
                        for d in range(size):
                            cosine += x[i, d] * x[j, d]
                        keep = ~(cosine < least) & (key[at[i]] != key[at[j]])
                    i, j, cosine = at[i[keep]], at[j[keep]], cosine[keep]
                    turned = key[i] > key[j]
                    a, b = np.where(turned, j, i), np.where(turned, i, j)
                    yield pa.record_batch([pa.repeat(label, len(a)).cast(types_[0]), ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(cosine)], names=["label", "a", "b", "cosine"])

    return similar_in


def similar_within(vectors: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs of one label with at least that cosine: every two blocks of a label's vectors meet in one task."""
    v = vectors.select("label", "vec_id", "embedding").where("label is not null and vec_id is not null and embedding is not null and not exists(embedding, v -> v is null)")
    sizes = vectors.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count("*").alias("labels")).first()
    types = dict(v.dtypes)
    n = blocks.number(sizes["most"] or 0, BLOCK, 4)
    return blocks.within(v, "vec_id", n, _similar(least), f"label {types['label']}, a {types['vec_id']}, b {types['vec_id']}, cosine double", ["label"], sizes["labels"])


def centroids(vectors: DataFrame) -> DataFrame:
    """Mean of each label's vectors, as (label, place, value)."""
    return vectors.select("label", F.posexplode("embedding").alias("place", "v")).groupBy("label", "place").agg(F.avg(F.col("v").cast("double")).alias("value"))


def html_sections(pages: DataFrame) -> DataFrame:
    """Title, language and numbers of links and paragraphs of each page."""
    html = F.col("html")
    return pages.select("page_id", F.regexp_extract(html, r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(html, r'<html lang="([a-z]*)"', 1).alias("lang"), (F.size(F.split(html, "<a ")) - 1).alias("links"), (F.size(F.split(html, "<p>")) - 1).alias("paragraphs"))
