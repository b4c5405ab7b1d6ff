"""URL filters: rules by longest match, and gradient-boosted trees on lexical features.

A rule is a host and a path; it fits that host and its subdomains when the URL's path starts with
the rule's, and the longest fitting rule decides.  URLs that no rule fits are judged by boosted
regression trees over length, depth, digit ratio, entropy, parameter counts and statistics of the
address suffix, trained on labelled URLs: by default those that a rule decides, a bounded sample
of them (``SAMPLE`` rows).  Suffix statistics are grouped aggregations over all labelled rows.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is
judged by the method; null ids and repeated rows each get a row; without labels of both classes
the method allows everything that isn't labelled alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, setjoin

SAMPLE = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (verdict, host, path) of the rules that the query applies.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def with_parts(pages: DataFrame, url_col: str) -> DataFrame:
    """Adds host, path and query (what stands between ? and #)."""
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    out = pages.withColumn("__rest", F.coalesce(rest, F.lit(""))).withColumn("__host", F.regexp_extract("__rest", "^[^/?#]*", 0))
    out = out.withColumn("path", F.regexp_extract(F.expr("substring(__rest, length(__host) + 1)"), "^[^?#]*", 0))
    query = F.coalesce(F.regexp_extract(F.col(url_col), r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    return out.withColumns({"query": query, "host": F.translate("__host", UPPER, LOWER)}).drop("__rest", "__host")


def rule_columns(rules):
    """(rule text, verdict) of the longest fitting rule."""
    text = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        text, verdict = F.when(fits, F.lit(host + path)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


FEATURES = ["length", "host_length", "path_length", "depth", "host_parts", "digit_ratio", "entropy", "parameters", "fragment", "hyphens", "secure", "suffix_rate", "suffix_count"]


def lexical(url: pa.Array, host: pa.Array, path: pa.Array, query: pa.Array) -> np.ndarray:
    """The features of URLs but for the two of their suffix, in array kernels."""
    url, host, path, query = (c.fill_null("") for c in (url, host, path, query))
    raw, offsets = setjoin.raw_text(url)
    size, row = np.diff(offsets), np.repeat(np.arange(len(url)), np.diff(offsets))
    entropy = np.zeros(len(url))
    for lo in range(0, len(url), 2048):  # 256 counters a row
        hi = min(len(url), lo + 2048)
        part = slice(offsets[lo], offsets[hi])
        counts = np.bincount((row[part] - lo) * 256 + raw[part], minlength=(hi - lo) * 256).reshape(hi - lo, 256)
        share = counts / np.maximum(1, size[lo:hi])[:, None]
        entropy[lo:hi] = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    digits = np.bincount(row[(raw >= 48) & (raw <= 57)], minlength=len(url)) / np.maximum(1, size)
    columns = [pc.utf8_length(url), pc.utf8_length(host), pc.utf8_length(path), pc.count_substring(path, "/"), pc.count_substring(host, "."), digits, entropy, pc.count_substring_regex(query, "[^&=]+="), pc.match_substring(url, "#"), pc.count_substring(url, "-"), pc.starts_with(url, "https")]
    return np.column_stack([np.asarray(c if isinstance(c, np.ndarray) else c.to_numpy(zero_copy_only=False), dtype=float) for c in columns])


@dataclass
class Trees:
    """Boosted regression trees of one depth, stored as complete binary trees."""

    base: float
    feature: np.ndarray  # tree x inner node
    cut: np.ndarray
    value: np.ndarray  # tree x leaf

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), dtype=int)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Gradient boosting with logistic loss and histogram splits; y is 0 or 1."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, value = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else []
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if len(x) else None
    score = np.full(len(y), base)
    for t in range(trees if len(x) else 0):
        p = 1 / (1 + np.exp(-score))
        g, h, node = y - p, p * (1 - p), np.zeros(len(y), dtype=int)
        for level in range(depth):
            first = 2**level - 1
            for n in range(first, 2 * first + 1):
                own = node == n
                best = (1e-6, 0, np.inf, None)
                G, H = g[own].sum(), h[own].sum()
                for j, e in enumerate(edges):
                    if not len(e) or not own.any():
                        continue
                    gl = np.cumsum(np.bincount(binned[own, j], weights=g[own], minlength=len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[own, j], weights=h[own], minlength=len(e) + 1))[:-1]
                    gain = np.where((hl > least / 4) & (H - hl > least / 4), gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge), 0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, float(e[k]), binned[:, j] > k)
                feature[t, n], cut[t, n] = best[1], best[2]
                node[own] = 2 * n + 1 + (best[3][own] if best[3] is not None else 0)
        for leaf in range(leaves):
            own = node == inner + leaf
            value[t, leaf] = rate * g[own].sum() / (h[own].sum() + ridge)
        score += value[t][node - inner]
    return Trees(base, feature, cut, value)


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per URL: page_id, host, path, rule, verdict, block_score.

    ``labels`` (url, blocked 0 or 1) trains the trees; by default the URLs that a rule decides do.
    """
    spark = pages.sparkSession
    rows = with_parts(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")), "url")
    text, verdict = rule_columns(rules)
    rows = rows.withColumns({"rule": text, "ruled": verdict, "suffix": F.substring_index("host", ".", -1)})
    known = rows.where("ruled is not null").select("url", "host", "path", "query", "suffix", (F.col("ruled") == "block").cast("int").alias("y")) if labels is None else with_parts(labels.select("url", F.col("blocked").cast("int").alias("y")).where("y is not null"), "url").withColumn("suffix", F.substring_index("host", ".", -1))
    total = known.agg(F.count("*").alias("n"), F.avg("y").alias("rate")).first()
    mean, n = float(total["rate"] or 0.0), int(total["n"])
    stats = known.groupBy(F.col("suffix").alias("__suffix")).agg(F.sum("y").cast("double").alias("__blocked"), F.count("*").alias("__held"))
    stats = common.materialise(stats, "suffixes")

    def with_stats(df: DataFrame, own=None) -> DataFrame:
        """Adds the suffix's smoothed rate of blocking and its size, without the row's own label ``own``."""
        less, one = (F.lit(0.0), F.lit(0)) if own is None else (own, F.lit(1))
        blocked, held = F.coalesce(F.col("__blocked") - less, F.lit(0.0)), F.coalesce(F.col("__held") - one, F.lit(0))
        joined = df.join(stats, F.col("suffix") == F.col("__suffix"), "left")
        return joined.withColumns({"suffix_rate": (blocked + 10 * mean) / (held + 10), "suffix_count": F.log(held + 1.0)})

    # every distinct URL of a share of the hashes, so that the fit sees the same rows in every run
    token = F.pmod(F.xxhash64("url"), F.lit(1 << 40))
    chosen = known.where(token < int(min(1.0, SAMPLE / max(1, n)) * (1 << 40))).groupBy("url", "host", "path", "query", "suffix").agg(F.max("y").alias("y"))
    sample = with_stats(chosen, F.col("y")).select("url", "host", "path", "query", "suffix_rate", "suffix_count", "y").orderBy(token, "url").limit(2 * SAMPLE).toArrow()
    lists = [sample.column(c).combine_chunks() for c in ("url", "host", "path", "query")]
    x = np.column_stack([lexical(*lists), sample.column("suffix_rate").to_numpy(), sample.column("suffix_count").to_numpy()])
    model = spark.sparkContext.broadcast(boost(x, sample.column("y").to_numpy().astype(float)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("url", "host", "path", "query")]
            feats = np.column_stack([lexical(*lists), batch.column("suffix_rate").to_numpy(), batch.column("suffix_count").to_numpy()])
            p = 1 / (1 + np.exp(-model.value.log_odds(feats)))
            yield pa.record_batch([*(batch.column(c) for c in ("page_id", "host", "path", "rule", "ruled")), pa.array(p)], names=["page_id", "host", "path", "rule", "ruled", "block_score"])

    scored = with_stats(rows).select("page_id", "url", "host", "path", "query", "rule", "ruled", "suffix_rate", "suffix_count").mapInArrow(score, "page_id long, host string, path string, rule string, ruled string, block_score double")
    verdict = F.coalesce("ruled", F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")


def op6(spark, sf_dir: str) -> DataFrame:
    return judge(common.read_table(spark, sf_dir, "pages"))
