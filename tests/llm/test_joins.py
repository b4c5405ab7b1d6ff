"""The as-of join, hard-negative mining and the shingle join against brute force and odd inputs."""

import bisect
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.llm import as_of, copies, negatives, setjoin, shingle_join

# ------------------------------------------------------------------ 11 as-of join


def brute_latest(left, right, tolerance):
    """Repeated left rows count once; right rows (id, key, t, rank) all count."""
    low = lambda x: (x is not None, x or 0)
    out = []
    for i, key, t in set(left):
        own = [r for r in right if key is not None and t is not None and r[1] == key and r[2] is not None and r[2] <= t]
        best = max(own, key=lambda r: (r[2], low(r[3]), low(r[0])), default=None)
        if best is None or t - best[2] > tolerance:
            out.append((i, key, t, None, None, None, 0))
        else:
            out.append((i, key, t, best[0], best[2], best[3], sum(r[2] == best[2] for r in own)))
    return sorted(out, key=str)


def latest(spark, left, right, tolerance, **more):
    a = spark.createDataFrame(left, "id long, key long, t long").withColumn("part", F.lit("x")).withColumn("n", F.lit(3))
    b = spark.createDataFrame(right, "id long, key long, t long, rank long").withColumn("summary", F.lit("y"))
    out = as_of.latest(a, b, tolerance, **more).select("id", "key", "t", "match_id", "match_t", "match_rank", "n_tied")
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 7), (3, 40)])
def test_latest_is_brute_force(spark, seed, parts):
    rng = random.Random(seed)
    pick = lambda n, none=0.05: None if rng.random() < none else rng.randrange(n)
    hot = lambda: 0 if rng.random() < 0.4 else pick(6)
    left = [(pick(300, 0.02), hot(), pick(60)) for _ in range(400)]
    right = [(pick(80, 0.1), hot(), pick(60), pick(4, 0.3)) for _ in range(300)]
    right += right[:40] * 3
    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch",)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # state is carried over many batches
    try:
        assert latest(spark, left + left[:30], right, 9, partitions=parts) == brute_latest(left, right, 9)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_latest_ties_over_partitions(spark):
    """One key and one time fill all partitions; every left row sees all ties."""
    right = [(i, 7, 100, i % 3) for i in range(500)]
    left = [(i, 7, 100 + i % 2) for i in range(200)] + [(900, 8, 100), (901, 7, 99)]
    assert latest(spark, left, right, 50, partitions=16) == brute_latest(left, right, 50)


@pytest.mark.parametrize(("left", "right"), [([], [(1, 1, 1, 1)]), ([(1, 1, 5), (2, None, 5), (3, 1, None)], []), ([(1, 1, 5)], [(1, None, 5, 1), (2, 1, None, 1)])])
def test_latest_of_empty_sides(spark, left, right):
    assert latest(spark, left, right, 9) == brute_latest(left, right, 9)


def test_carried():
    ends = [(1, 5, 10, 1, 1, 2), (3, 5, 10, 2, 9, 4), (4, 6, 1, None, None, 1)]
    assert as_of.carried(ends, 6) == [(2, 5, 10, 1, 1, 2), (3, 5, 10, 1, 1, 2), (4, 5, 10, 2, 9, 6), (5, 6, 1, None, None, 1)]


def test_clicks_to_orders(spark, tiny):
    """The contract, spelled out in Python on the whole small tables."""
    clicks = spark.read.parquet(f"{tiny}/clicks.parquet")
    sales = spark.read.parquet(f"{tiny}/sales.parquet")
    crc = lambda i: zlib.crc32(str(i).encode())
    us = lambda d: None if d is None else (d - np.datetime64("1970-01-01").astype("datetime64[us]").item()) // np.timedelta64(1, "us").item()
    floored = lambda i, t: t - t % as_of.STEP if t is not None and crc(i) % 2 else t
    orders = {}
    for r in sales.collect():
        t, cents = floored(r.sale_id, us(r.sold_at)), None if r.total is None else int(np.floor(100 * r.total + 0.5))
        if r.client_id is not None and t is not None:
            for i in [r.sale_id] + ([-1 - r.sale_id] if crc(r.sale_id) % 3 else []):
                orders.setdefault(r.client_id, []).append((t, cents is not None, cents or 0, i))
    for own in orders.values():
        own.sort()
    want = set()
    for r in clicks.collect():
        t = floored(r.click_id, us(r.ts))
        own = orders.get(r.client_id, []) if t is not None else []
        k = bisect.bisect_right(own, (t, True, float("inf"), 0)) if own else 0
        row = (r.click_id, r.client_id, t)
        if k and t - own[k - 1][0] <= 720 * as_of.HOUR:
            best = own[k - 1]
            row += (best[3], t - best[0], best[2] if best[1] else None, sum(o[0] == best[0] for o in own))
        else:
            row += (None, None, None, 0)
        want.add(row)
    got = [tuple(r) for r in as_of.op11(spark, tiny).collect()]
    assert len(got) == len(want) and set(got) == want


def test_micros_do_not_depend_on_the_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp_ntz'2024-03-10 02:30:01.000007' as t union all select timestamp_ntz'1969-12-31 23:59:59.5'")
        assert sorted(r[0] for r in df.select(as_of.micros(df, "t")).collect()) == [-500_000, 1_710_037_801_000_007]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


# ------------------------------------------------------------------ 12 hard negatives


def brute_negatives(rows, anchor, positives=5, count=5, low=80, scale=256):
    ok = {(i, lab, tuple(int(np.floor(scale * float(x))) for x in v)) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, lab, v in ok:
        if not anchor(i):
            continue
        ranked = sorted(((-min(sum(a * b for a, b in zip(v, w, strict=True)), 2**63 - 1), j, m) for j, m, w in ok if j != i))
        for s, p, m in [x for x in ranked if x[2] == lab][:positives]:
            near = [(t, j) for t, j, k in ranked if k != lab and 80 * -s <= 100 * -t <= 100 * -s][:count]
            out += [(i, p, r, j, -s, -t) for r, (t, j) in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as token", "2 as q", "3 as anchor", "'z' as e")
    out = negatives.mine(df.repartition(4), F.col("vec_id") % 5 == 0, **more)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("blocks", [None, (16, 4)])
def test_negatives_are_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(negatives, "ROWS", blocks[0])
        monkeypatch.setattr(negatives, "ANCHORS", blocks[1])
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)], rng.randrange(3)) for i in range(120)]
    rows += rows[:10] + [(None, [1.0] * 4, 1), (200, None, 1), (201, [1.0, None, 0.0, 1.0], 1), (202, [float("nan")] * 4, 2), (203, [1.0] * 4, None), (205, [0.0] * 4, 1)]
    got = mined(spark, rows)
    assert got and got == brute_negatives(rows, lambda i: i % 5 == 0)


def test_negatives_of_large_components_and_none(spark):
    rows = [(i, [1e12 * (i + 1), 3.0 * i], i % 2) for i in range(12)]
    got = mined(spark, rows)
    assert got and got == brute_negatives(rows, lambda i: i % 5 == 0)
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []


# ------------------------------------------------------------------ 13 shingle join


def brute_classes(rows, threshold=0.8):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").replace(" ", "_").split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def joined(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as copy", "1 as class", "2 as n", "'r' as root")
    return sorted((tuple(r) for r in shingle_join.jaccard_join(df.repartition(3)).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def near_copies(rng, n_words, vocabulary, copies_of):
    base = [rng.choice(vocabulary) for _ in range(n_words)]
    for _ in range(copies_of):
        w = list(base)
        for _ in range(rng.randrange(0, max(2, n_words // 30) + 1)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
        yield " ".join(w)


def test_shingle_join_is_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "Ab"]
    texts = [t for n in (3, 5, 6, 9, 12, 25, 60, 150, 400) for _ in range(4) for t in near_copies(rng, n, vocabulary, 5)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=rng.randrange(5, 90))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "One"), (None, texts[30]), (None, None), (5, texts[5]), (5, texts[90])]
    rows += [(2000, "a a b c d e e"), (2001, "e e b c d a a"), (2002, "Aa " * 4000), (2003, "aa " * 5)]
    rng.shuffle(rows)
    assert joined(spark, rows) == brute_classes(rows)
    assert joined(spark, []) == []


def test_equal_words_do_not_cancel():
    import pyarrow as pa

    row, gram = copies.shingles(pa.array(["a a b c d", "e e b c d", "a a a a a", "e e e e e"]))
    assert len(set(gram.tolist())) == 4 and row.tolist() == [0, 1, 2, 3]


@pytest.mark.parametrize("counts", ["none", "all", "random"])
@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_every_close_pair_meets(counts, threshold):
    """Whatever the costs are: of two sets in reach one asks for a key that the other is indexed under."""
    rng = np.random.default_rng(5)
    bands, size = shingle_join.Bands(threshold), 1 << setjoin.SKETCH_BITS
    sketch = {"none": np.zeros(size, int), "all": np.full(size, 10**6), "random": rng.integers(0, 3000, size)}[counts]
    for _ in range(400):
        n = int(rng.integers(1, 40)) if rng.random() < 0.6 else int(rng.integers(40, 700))
        base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        most = int((1 - threshold) * n) + 1
        gone, more = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
        a, b = base[:n], np.r_[base[gone:n], base[n : n + more]]
        if not len(b) or (n - gone) / (n + more) < threshold or (gone == more == 0):
            continue
        key, of, flags = shingle_join.entries(np.r_[a, b], np.array([len(a), len(b)]), bands, sketch)
        of_a, of_b = ({int(k): int(f) for k, f in zip(key[of == s], flags[of == s], strict=True)} for s in (0, 1))
        either = {}
        for s in (0, 1):
            for k, f in zip(key[of == s].tolist(), flags[of == s].tolist(), strict=True):
                either.setdefault(k, [0, 0])[s] |= f
        assert any(x & shingle_join.INDEXED and y & shingle_join.ASKED or y & shingle_join.INDEXED and x & shingle_join.ASKED for x, y in either.values()), (n, gone, more)
        assert of_a and of_b
