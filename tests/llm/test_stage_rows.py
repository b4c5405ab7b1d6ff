"""The filtering stages on ids that repeat, empty tables and clashing column names; URL features against a plain loop."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quorate.llm import copies, decontaminate, language, lines, setjoin, simhash, urls, shingle_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, signature long, root string, line_no int, __id string"
LONG = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil strange potions in a tall tower by the sea"
OTHER = "nobody expected that the library would open on a sunday morning in the middle of winter with all its lamps lit and warm"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "h", len(t or ""), "c", 1, "r", 2, "x") for i, t in rows], SCHEMA)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_a_text_of_its_own_survives_under_a_repeated_id(spark):
    rows = frame(spark, [(1, LONG), (5, LONG), (5, OTHER), (None, LONG), (1, LONG)])
    for survivors in (simhash.survivors, copies.survivors, shingle_join.survivors):
        out = survivors(rows)
        assert out.columns == rows.columns
        assert kept(out) == sorted([(1, LONG), (5, OTHER), (None, LONG)], key=str)


def test_decisions_are_by_id_and_text(spark):
    bench = spark.createDataFrame([(9, OTHER)], "item_id long, text string")
    rows = frame(spark, [(3, OTHER), (3, LONG), (4, LONG), (None, OTHER), (6, None)])
    out = decontaminate.without_leaks(rows, bench)
    assert out.columns == rows.columns
    assert kept(out) == sorted([(3, LONG), (4, LONG), (None, OTHER), (6, None)], key=str)
    marked = frame(spark, [(k, LONG) for k in range(20)] + [(7, "12 34"), (7, OTHER)])
    assert (7, "12 34") not in kept(language.keep_identified(marked)) and (7, OTHER) in kept(language.keep_identified(marked))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, tiny, name):
    empty = frame(spark, [(1, "x")]).where("false")
    out = dict(corpus_pipeline.STAGES)[name](spark, empty, tiny)
    assert out.count() == 0
    if name != "packing":
        assert out.columns == empty.columns


def test_lines_keep_other_columns(spark):
    rows = frame(spark, [(1, f"{LONG}\n{OTHER}"), (2, f"{LONG}!\nown words here"), (3, LONG)])
    out = lines.without_repeats(rows)
    assert out.columns == rows.columns
    assert kept(out) == [(1, f"{LONG}\n{OTHER}"), (2, "own words here")]


def test_connected_runs_equal_all_pairs():
    """Runs that are finished directly link what comparing all pairs links."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40)
    sets = [np.unique(np.r_[base[: 40 - k % 5], rng.integers(0, 2**63, k % 5)]) for k in range(300)] + [np.unique(rng.integers(0, 2**63, 40)) for _ in range(40)]
    member, n = np.concatenate(sets).astype(np.uint64), np.array([len(s) for s in sets])
    _, parity = setjoin.describe(member, np.cumsum(n), n, 1)
    order = np.argsort(n, kind="stable")
    forests = [simhash.Forest(len(sets)) for _ in range(2)]
    setjoin.connect(np.zeros(len(sets)), n[order], np.zeros(len(sets), int), order, parity[order, 0], forests[0], 0.8)
    x, y = np.triu_indices(len(sets), 1)
    small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
    need = setjoin.overlap_needed(n[x], n[y], 0.8)
    near = (small >= np.ceil(0.8 * large - 1e-9)) & (small >= need) & (np.bitwise_count(parity[x, 0] ^ parity[y, 0]) <= n[x] + n[y] - 2 * need)
    forests[1].link(x[near], y[near])
    roots = [f.roots(np.arange(len(sets))) for f in forests]
    assert (roots[0] == roots[1]).all() and len(set(roots[0].tolist())) > 10


def test_url_features_match_a_plain_loop():
    rows = [("https://A.b.com/x-1/y?q=1&r=2&s#f=3", "a.b.com", "/x-1/y"), (None, "", ""), ("", "", ""), ("nonsense ü 42", "", ""), ("http://h/" + "a1" * 500 + "?" + "k=v&" * 50, "h", "/" + "a1" * 500)]
    query = [(u or "").partition("#")[0].partition("?")[2] for u, _, _ in rows]
    got = urls.lexical(*(pa.array(c, pa.string()) for c in (*zip(*rows, strict=True), query)))
    for (url, host, path), q, row in zip(rows, query, got, strict=True):
        raw = (url or "").encode()
        entropy = -sum(c / len(raw) * math.log2(c / len(raw)) for c in Counter(raw).values())
        digits = sum(48 <= b <= 57 for b in raw) / max(1, len(raw))
        want = [len(url or ""), len(host), len(path), path.count("/"), host.count("."), digits, entropy, len(re.findall("[^&=]+=", q)), "#" in (url or ""), (url or "").count("-"), (url or "").startswith("https")]
        assert np.allclose(row, np.array(want, dtype=float))
