"""Language identification by Bayesian evidence fusion.

Text likelihoods come from hashed byte trigrams, one multinomial per language, fitted on a bounded
sample of declared rows (``SAMPLE_ROWS`` a language).  A language has a model, regions folded together, if
at least a share ``SMALLEST_SHARE`` of the declared rows names it, so there are 1000 models at most; rarer
declarations are missing evidence, and their rows are judged by text and host.  The models are fused with the declared (markup)
language and with host priors that are smoothed hierarchically: all rows, address suffix,
registered domain, host.  The declaration table and the priors are grouped aggregations over all
rows.  Neighbouring trigrams depend on one another, so a text counts as ``EFFECTIVE`` trigrams at
most, at its mean log likelihood; otherwise long texts would drown the other evidence.

``und`` (undetermined) is a class of its own with uniform trigrams.  A document is accepted when
its best class isn't ``und`` and has a posterior of at least ``threshold``.

Defined results: null or letterless texts are ``und`` with the evidence of zero trigrams and are
not accepted; a null declaration, host or URL is missing evidence; null ids and repeated rows each
get a row; an empty table or one without declarations gives ``und`` everywhere; other columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, ngrams

#: Rows per declared language that the trigram model is fitted on, about.
SAMPLE_ROWS = 3000
#: Share of the declared rows that a language needs for a model of its own; its inverse bounds the models.
SMALLEST_SHARE = 0.001
BITS = 16
EFFECTIVE = 150
#: Trigrams that a text needs to count for its host and its declaration.
TELLING = 10
UNKNOWN = "und"
_TABLE = ngrams.byte_map(letters_only=True)


def base_language(declared: Column) -> Column:
    """A declaration without its region or script: "pt-BR" and "PT_pt" are "pt"."""
    return F.lower(F.trim(F.substring_index(F.translate(declared, "_", "-"), "-", 1)))


def fit(docs: DataFrame, text_col: str, declared_col: str, key_col: str, smallest: float = SMALLEST_SHARE) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each bucket for each language, the last row for ``und``)."""
    rows = docs.select(F.col(key_col).alias("k"), F.col(text_col).alias("text"), base_language(F.col(declared_col)).alias("lang")).where("lang is not null and lang <> '' and text is not null")
    declared = common.materialise(rows.groupBy("lang").count(), "declarations")
    total = declared.agg(F.sum("count")).first()[0] or 0
    found = declared.where(F.col("count") >= smallest * total).collect()  # 1 / smallest rows at most
    names = sorted(r["lang"] for r in found)
    if not names:
        return [UNKNOWN], np.full((1, 1 << BITS), -BITS * np.log(2), dtype=np.float32)
    rates = {r["lang"]: min(1.0, SAMPLE_ROWS / r["count"]) for r in found}
    rate = F.coalesce(F.create_map(*(x for k, v in rates.items() for x in (F.lit(k), F.lit(v))))[F.col("lang")], F.lit(0.0))
    sample = rows.where(F.col("lang").isin(names)).where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < rate * 1_000_000).select("text", "lang")

    @common.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), 1 << BITS), dtype=np.int64)
        place = {n: i for i, n in enumerate(names)}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, codes, bounds in ngrams.coded(batch.column("text"), _TABLE, BITS):
                for i in range(len(bounds) - 1):
                    np.add.at(sums[place[langs[lo + i]]], codes[bounds[i] : bounds[i + 1]], 1)
        lang, bucket = np.nonzero(sums)
        yield pa.record_batch([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[lang, bucket])], names=["lang", "bucket", "n"])

    counts = np.zeros((len(names), 1 << BITS))
    # at most 2**BITS small rows a language reach the driver
    table = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts[table["lang"], table["bucket"]] = table["n"]
    smooth = 0.05
    logs = np.log((counts + smooth) / (counts.sum(1, keepdims=True) + smooth * (1 << BITS)))
    return [*names, UNKNOWN], np.vstack([logs, np.full((1, 1 << BITS), -BITS * np.log(2))]).astype(np.float32)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source", url_col: str | None = None, threshold: float = 0.5, strength: float = 20.0, smallest: float = SMALLEST_SHARE) -> DataFrame:
    """One row per document: doc_id, language, confidence, accepted, text_language, n_grams, copy (a hash of the text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.lower(F.col(declared_col)) if declared_col else F.lit(None).cast("string")).alias("declared"), (F.col(url_col) if url_col else F.lit(None).cast("string")).alias("__u"), (F.col(host_col) if host_col else F.lit(None).cast("string")).alias("__h"))
    address = F.when(F.instr("__u", "://") > 0, F.expr("substring(__u, instr(__u, '://') + 3)"))
    host = F.translate(F.coalesce(F.regexp_extract(address, "^[^/?#:]*", 0), F.col("__h")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rows.withColumn("host", host).drop("__u", "__h")
    names, logs = fit(rows, "text", "declared", "doc_id", smallest)
    book = spark.sparkContext.broadcast(logs)  # 2**BITS numbers a language

    @common.tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(book.value)
        for batch in batches:
            n, out = np.zeros(batch.num_rows, dtype=np.int64), np.zeros((batch.num_rows, len(table)))
            for lo, codes, bounds in ngrams.coded(batch.column("text"), _TABLE, BITS):
                hi = lo + len(bounds) - 1
                n[lo:hi] = np.diff(bounds)
                for k, row in enumerate(table):
                    out[lo:hi, k] = ngrams.row_sums(row[codes], bounds)
            mean = out / np.maximum(n, 1)[:, None]
            like = mean * np.minimum(n, EFFECTIVE)[:, None]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(table), pa.int32()), pa.array(like.ravel()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("copy"), batch.column("declared"), batch.column("host"), pa.array(n), flat], names=["doc_id", "copy", "declared", "host", "n_grams", "like"])

    scored = rows.withColumn("copy", common.copy_of(F.col("text"))).mapInArrow(score, "doc_id long, copy long, declared string, host string, n_grams long, like array<double>")
    size = len(names)
    best = F.when(F.col("n_grams") > 0, F.expr("array_position(like, array_max(like)) - 1").cast("int")).otherwise(size - 1)
    suffix = F.when(F.instr("host", ".") > 0, F.substring_index("host", ".", -1))
    domain = F.when(F.instr("host", ".") > 0, F.substring_index("host", ".", -2))
    seen = common.materialise(scored.withColumns({"guess": best, "suffix": suffix, "domain": domain}), "likelihoods")

    per_class = [F.count_if((F.col("guess") == i) & (F.col("n_grams") >= TELLING)).cast("double").alias(f"n{i}") for i in range(size)]
    counts = F.array(*(F.col(f"n{i}") for i in range(size)))
    everywhere = seen.agg(*per_class).first()
    total = sum(everywhere) or 0.0
    overall = F.array(*(F.lit((everywhere[i] + 1.0) / (total + size)) for i in range(size)))

    def smoothed(n: Column, parent: Column) -> Column:
        whole = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, parent, lambda x, p: (x + strength * p) / (whole + strength))

    by_suffix = seen.where("suffix is not null").groupBy("suffix").agg(*per_class).select("suffix", smoothed(counts, overall).alias("p_suffix"))
    by_domain = seen.where("domain is not null").groupBy("domain", "suffix").agg(*per_class).select("domain", "suffix", counts.alias("n"))
    by_domain = by_domain.join(by_suffix, "suffix").select("domain", smoothed(F.col("n"), F.col("p_suffix")).alias("p_domain"))
    by_host = seen.where("host is not null").groupBy("host", "domain").agg(*per_class).select("host", F.col("domain").alias("d"), counts.alias("n"))
    by_host = by_host.join(by_domain, F.col("d") == F.col("domain"), "left").select(F.col("host").alias("h"), smoothed(F.col("n"), F.coalesce("p_domain", overall)).alias("p_host"))
    by_host = common.materialise(by_host, "hosts")
    # P(declared | language), smoothed towards the share of that declaration
    by_claim = seen.where(base_language(F.col("declared")).isin(names)).groupBy("declared").agg(*per_class, F.count("*").alias("rows"))
    claimed = [F.lit(max(everywhere[i], 0.0)) for i in range(size)]
    by_claim = by_claim.select(F.col("declared").alias("c"), F.array(*((F.col(f"n{i}") + strength * (F.col("rows") / max(total, 1.0))) / (claimed[i] + strength) for i in range(size))).alias("p_claim"))
    by_claim = common.materialise(by_claim, "claims")

    ones = F.array(*(F.lit(1.0) for _ in range(size)))
    fused = seen.join(by_host, F.col("host") == F.col("h"), "left").join(by_claim, F.col("declared") == F.col("c"), "left")
    fused = fused.withColumn("log", F.zip_with(F.col("like"), F.zip_with(F.coalesce("p_host", overall), F.coalesce("p_claim", ones), lambda p, q: F.log(p) + F.log(q)), lambda a, b: a + b))
    fused = fused.withColumn("top", F.array_max("log"))
    weight = F.aggregate(F.transform("log", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    labels = F.array(*(F.lit(n) for n in names))
    pick = lambda place: F.element_at(labels, place.cast("int"))
    language = F.when(F.col("n_grams") > 0, pick(F.expr("array_position(log, top)"))).otherwise(F.lit(UNKNOWN))
    out = fused.select("doc_id", "copy", language.alias("language"), (1 / weight).alias("confidence"), pick(F.col("guess") + 1).alias("text_language"), "n_grams")
    return out.withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("confidence") >= threshold)).select("doc_id", "language", "confidence", "accepted", "text_language", "n_grams", "copy")


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose id and text have no accepted row; rows without an id stay."""
    found = identify(docs, **options).where("doc_id is not null").groupBy("doc_id", "copy").agg(F.max("accepted").alias("ok"))
    rejected = common.materialise(found.where(~F.col("ok")).select("doc_id", "copy"), "rejected")
    return common.by_copy(docs, options.get("id_col", "doc_id"), options.get("text_col", "text"), rejected, "left_anti")


def op1(spark, sf_dir: str) -> DataFrame:
    return identify(common.read_table(spark, sf_dir, "documents"))
