"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased and cut into runs of letters and digits; a shingle is five words.  Windows of
a document are as long as a benchmark item and are laid where a shingle of the item takes the same
place in the window as in the item (a window and an item that share no shingle have similarity
zero, so all others need no fingerprint).  Windows and items get a 64-bit SimHash of their
shingles, weighted by how often each occurs.  A multi-index over ``BLOCKS`` bit blocks finds all
pairs within ``RADIUS`` bits: two such fingerprints differ in at most RADIUS // BLOCKS bits of some
block, and items are entered under every block value that near.  What it finds is verified by the
exact weighted Jaccard similarity of the shingles.

Two hash independent texts of similarity 0.8 differ in 9.6 bits on average, 17 is 2.6 standard
deviations above; a near copy beyond the radius is the one kind of match that isn't found.

Defined results: null and short texts (fewer than five words) hold and match nothing; rows without
an id take no part (a document without an id stays in a filtering); repeated ids are told apart by
their text and reported once with their best match; a document shorter than an item is one window;
empty tables give an empty result; other columns don't matter.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
THRESHOLD = 0.8
BITS, BLOCKS, RADIUS = 64, 6, 17


def with_shingles(df: DataFrame, text: str) -> DataFrame:
    """Adds the hashes of a text's shingles in order; empty for fewer than five words."""
    words = f"array_remove(split(lower(`{text}`), '[^\\\\p{{L}}\\\\p{{N}}]+', -1), '')"
    rolled = f"transform(sequence(0, size(h) - {SHINGLE}), i -> xxhash64({', '.join(f'get(h, i + {k})' for k in range(SHINGLE))}))"
    # the word hashes are bound to h, so that they are computed once for all shingles
    return df.withColumn("shingles", F.expr(f"transform(array(transform({words}, w -> xxhash64(w))), h -> if(size(h) >= {SHINGLE}, {rolled}, cast(array() as array<bigint>)))[0]"))


def fingerprints(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp, weight) from (keys, shingle, weight): a bit is set if over half of the weight has it."""
    ones = [F.sum(F.when(F.shiftright("shingle", b).bitwiseAND(F.lit(1).cast("long")) == 1, F.col("weight")).otherwise(0)).alias(f"b{b}") for b in range(BITS)]
    counted = weighted.groupBy(*keys).agg(F.sum("weight").alias("total"), *ones)
    bits = [F.when(F.col(f"b{b}") * 2 > F.col("total"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(BITS)]
    return counted.select(*keys, reduce(lambda x, y: x.bitwiseOR(y), bits).alias("fp"), "total")


def _blocks() -> list[tuple[int, int, int]]:
    edges = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    return [(i, edges[i], edges[i + 1] - edges[i]) for i in range(BLOCKS)]


def _block_value(low: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def block_keys(df: DataFrame) -> DataFrame:
    """One row per block of each fingerprint."""
    entries = [F.struct(F.lit(i).alias("block"), _block_value(low, width).alias("value")) for i, low, width in _blocks()]
    return df.withColumn("__k", F.explode(F.array(*entries))).withColumns({"block": F.col("__k.block"), "value": F.col("__k.value")}).drop("__k")


def block_probes(df: DataFrame) -> DataFrame:
    """One row per block and block value within RADIUS // BLOCKS bits of each fingerprint's."""
    def near(block: int, low: int, width: int) -> Column:
        masks = [sum(1 << b for b in bits) for r in range(RADIUS // BLOCKS + 1) for bits in combinations(range(width), r)]
        return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: F.struct(F.lit(block).alias("block"), _block_value(low, width).bitwiseXOR(m).alias("value")))

    entries = [near(*block) for block in _blocks()]
    return df.withColumn("__k", F.explode(F.concat(*entries))).withColumns({"block": F.col("__k.block"), "value": F.col("__k.value")}).drop("__k")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, copy, item_id, similarity, start, distance): every window and item that match; copy is a hash of the document's text."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null").distinct()
    items = with_shingles(items, "text").where("size(shingles) > 0").select("item_id", F.xxhash64("text").alias("item_copy"), F.size("shingles").alias("n"), "shingles")
    items = common.materialise(items, "items")
    places = common.materialise(items.select("n", F.posexplode("shingles").alias("place", "shingle")).distinct(), "item-shingles")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.copy_of(F.col(text_col)).alias("copy"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    each = with_shingles(rows, "text").select("doc_id", "copy", F.size("shingles").alias("held"), F.posexplode("shingles").alias("at", "shingle"))
    hits = each.join(places, "shingle").select("doc_id", "copy", "held", "n", (F.col("at") - F.col("place")).alias("start"))
    # windows end with the document
    start = F.greatest(F.lit(0), F.least(F.col("start"), F.col("held") - F.col("n")))
    windows = common.materialise(hits.select("doc_id", "copy", "n", start.alias("start")).distinct(), "windows")

    touched = common.materialise(windows.select("doc_id", "copy").distinct(), "touched")
    near = rows.join(touched, ["doc_id", "copy"], "left_semi").distinct()
    near = with_shingles(near, "text").select("doc_id", "copy", "shingles")
    keys = ["doc_id", "copy", "n", "start"]
    cut = windows.join(near, ["doc_id", "copy"]).select(*keys, F.expr("slice(shingles, start + 1, n)").alias("part"))
    weighted = common.materialise(cut.select(*keys, F.explode("part").alias("shingle")).groupBy(*keys, "shingle").agg(F.count("*").alias("weight")), "window-shingles")
    item_weighted = common.materialise(items.select("item_id", "item_copy", "n", F.explode("shingles").alias("shingle")).groupBy("item_id", "item_copy", "n", "shingle").agg(F.count("*").alias("weight")), "item-weights")

    marked = fingerprints(weighted, keys)
    entered = fingerprints(item_weighted, ["item_id", "item_copy", "n"])
    probes = common.materialise(block_probes(entered).select("item_id", "item_copy", "n", "block", "value", F.col("fp").alias("item_fp"), F.col("total").alias("item_total")), "item-probes")
    met = block_keys(marked).join(probes, ["n", "block", "value"]).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).where(F.col("distance") <= RADIUS)
    pairs = common.materialise(met.select(*keys, "item_id", "item_copy", "total", "item_total", "distance").distinct(), "pairs")
    # a shared shingle counts with the smaller of its two weights
    shared = pairs.join(weighted, keys).join(item_weighted.select("item_id", "item_copy", "shingle", F.col("weight").alias("item_weight")), ["item_id", "item_copy", "shingle"])
    common_weight = shared.groupBy(*keys, "item_id", "item_copy", "total", "item_total", "distance").agg(F.sum(F.least("weight", "item_weight")).alias("both"))
    scored = common_weight.withColumn("similarity", F.col("both") / (F.col("total") + F.col("item_total") - F.col("both"))).where(F.col("similarity") >= threshold)
    return scored.select("doc_id", "copy", "item_id", "similarity", "start", "distance")


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, similarity, start, distance): the best window of each document and item that match; options as of ``matches``.

    ``start`` counts words from 0, ``distance`` the differing bits of the fingerprints.
    """
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("distance")).alias("d")))
    return matches(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.similarity", (-F.col("m.s")).alias("start"), (-F.col("m.d")).alias("distance"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the texts that hold a benchmark item; options as of ``matches``."""
    leaking = common.materialise(matches(docs, benchmark, **options).select("doc_id", "copy").distinct(), "leaking")
    return common.by_copy(docs, options.get("id_col", "doc_id"), options.get("text_col", "text"), leaking, "left_anti")


def op2(spark, sf_dir: str) -> DataFrame:
    return leaks(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))
