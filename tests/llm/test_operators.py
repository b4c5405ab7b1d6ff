"""The pipeline operators against brute force, round trips and odd inputs."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorate.llm import chat, common, decontaminate, language, lines, multi_index, ngram_model, packing, quality, setjoin, simhash, urls
from quorate.llm.elias_fano import Sequence, read_arrays, write_arrays

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id long, copy string, fp string"


def docs(spark, rows):
    """Rows of (id, text, lang) with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, lang, "h", None, 5, "x", "y") for i, t, lang in rows], SCHEMA).repartition(3)


WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    long = prose(rng, 60_000)
    base = prose(rng, 80)
    return docs(spark, [(1, None, "en"), (2, "", "en"), (3, "   \n\t", None), (4, long, "fr"), (5, long, "fr"), (6, base, None), (6, base, None), (None, base, "en"), (7, base + " tail", "en"), (8, "one", "en"), (9, "one two", "")])


# ------------------------------------------------------------------ 3 near-dedup


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=3):
    fp = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    arr = np.array(fp, dtype=np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= radius) + i + 1:
            parent[root(int(j))] = root(i)
    best = {}
    for i, (k, _) in enumerate(rows):
        r = root(i)
        best[r] = min((x for x in (best.get(r), k) if x is not None), default=None)
    return sorted(((k, f"{fp[i]:016x}", best[root(i)]) for i, (k, _) in enumerate(rows)), key=str)


def test_near_dedup_matches_brute_force(spark, tiny):
    table = common.read_table(spark, tiny, "documents")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in simhash.op3(spark, tiny).collect()), key=str)
    assert got == brute_components(rows)


def test_near_dedup_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in simhash.near_duplicates(odd).collect()), key=str)
    assert got == brute_components(rows)
    kept = simhash.survivors(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted({c for _, _, c in brute_components(rows)} | {None}, key=str)


def test_trie_join_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(48, rng.integers(0, 5), replace=False)) for _ in range(1500)], dtype=np.uint64)
    values = np.unique(rng.choice(base, 1500) ^ flips)
    groups = (values >> np.uint64(48)).astype(np.int64)
    got = set()
    for x, y in simhash.trie_self_join(groups, values, 3, shared=16, leaf=2, front=64):
        got |= {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if groups[i] == groups[j] and (int(values[i]) ^ int(values[j])).bit_count() <= 3}
    assert got == want


def test_components_of_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {101: 100, 103: 100}


# ------------------------------------------------------------------ 10 line dedup


def brute_lines(rows, threshold=0.8):
    table = []
    for i, t in rows:
        if i is None:
            continue
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(line.encode().lower().split())
            if s:
                table.append((i, k, s))
    sets = list({s for _, _, s in table})
    first = {}
    for i, k, s in table:
        first[s] = min(first.get(s, (i, k)), (i, k))
    near = {s: [] for s in sets}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= threshold * max(len(x), len(y)) - 1e-9 and len(x & y) / len(x | y) >= threshold - 1e-12:
                near[x].append(y)
                near[y].append(x)
    out = []
    for i, k, s in table:
        match = min([first[s], *(first[o] for o in near[s])])
        out.append((i, k, len(s), len(near[s]), *match, match < (i, k)))
    return sorted(out)


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    common_words, rows = WORDS[:6], []
    pool = [prose(rng, rng.randint(4, 30)) for _ in range(60)]
    for i in range(120):
        part = []
        for _ in range(rng.randint(1, 5)):
            line = rng.choice(pool).split()
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice(WORDS)
            part.append(" ".join(line) if rng.random() < 0.8 else " ".join(rng.choices(common_words, k=12)).upper())
        rows.append((i, "\n".join(part), "en"))
    rows += [(200, None, None), (201, "", None), (None, rows[0][1], "en"), (202, rows[0][1], "en"), (202, rows[0][1], "en")]
    want = brute_lines([r[:2] for r in rows])
    names = ("doc_id", "line_no", "n_words", "links", "match_doc_id", "match_line_no", "removed")
    saved = setjoin.BLOCK
    # words entered in pairs always, sometimes, never; blocks of two lines or more
    for frequent, setjoin.BLOCK in ((0, 2), (5, 3), (10**9, 40), (5, 2048)):
        got = sorted(tuple(r[n] for n in names) for r in lines.line_matches(docs(spark, rows), frequent=frequent).collect())
        assert got == want, (frequent, setjoin.BLOCK)
    setjoin.BLOCK = saved
    gone = {(r[0], r[1]) for r in want if r[-1]}
    kept = {(r.doc_id, r.text) for r in lines.without_repeats(docs(spark, rows)).collect()}
    for i, t, _ in rows:
        left = t if t is None or i is None or not any(g[0] == i for g in gone) else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert ((i, left) in kept) == (left is None or i is None or not any(g[0] == i for g in gone) or left.strip() != "")


# ------------------------------------------------------------------ 2 decontamination


def _shingles(text):
    import regex

    w = regex.sub(r"[^\p{L}\p{N}]+", " ", (text or "").lower()).split()
    return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]


def brute_leaks(rows, items, threshold=0.8):
    out = {}
    for item, text in items:
        s = _shingles(text)
        n, own = len(s), collections.Counter(s)
        if not n or item is None:
            continue
        for doc, body in rows:
            d = _shingles(body)
            if doc is None or not d:
                continue
            places = {max(0, min(i - j, len(d) - n)) for j, x in enumerate(s) for i, y in enumerate(d) if x == y}
            for p in sorted(places):
                w = collections.Counter(d[p : p + n])
                both = sum((own & w).values())
                sim = both / (n + sum(w.values()) - both)
                if sim >= threshold and sim > out.get((doc, item), 0):
                    out[doc, item] = sim
    return out


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randint(12, 40))) for i in range(12)] + [(90, "too short"), (91, None), (None, prose(rng, 20)), (5, prose(rng, 15))]
    rows = [(i, prose(rng, 120)) for i in range(30)]
    for i in range(40, 90):
        text = rng.choice(items[:12])[1].split()
        if i % 3 == 0:
            text[rng.randrange(len(text))] = "other"
        if i % 5 == 0:
            text.insert(rng.randrange(len(text)), "more")
        rows.append((i, f"{prose(rng, rng.randint(0, 30))} {' '.join(text).upper()}, {prose(rng, rng.randint(0, 30))}"))
    rows += [(100, None), (101, ""), (102, "one two"), (None, items[0][1]), (40, rows[30][1])]
    table = docs(spark, [(i, t, "en") for i, t in rows])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.leaks(table, bench).collect()}
    assert got == {k: round(v, 9) for k, v in brute_leaks(rows, items).items()}
    left = {r.doc_id for r in decontaminate.without_leaks(table, bench).collect()}
    assert left == {i for i, _ in rows} - {d for d, _ in got}


# ------------------------------------------------------------------ 5 packing


def brute_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, packing.END_ID] for x in texts]


def test_packing_round_trip(spark, tiny, odd):
    extra = ["it's É́ Σας, x\x1cy 12.5... a\u00a0b İ, ﬁ 你好, <|endoftext|> <|ENDOFTEXT|>b"]
    tables = [common.read_table(spark, tiny, "documents"), odd, docs(spark, [(i, t, "en") for i, t in enumerate(extra)])]
    for table in tables:
        pieces = packing.pack(table).toPandas()
        rows = table.select("doc_id", "text").collect()
        want = collections.Counter((r.doc_id, tuple(ids)) for r, ids in zip(rows, brute_ids([r.text for r in rows])))
        total = sum(len(ids) * n for (_, ids), n in want.items())
        assert pieces["length"].sum() == total
        for _, seq in pieces.sort_values("offset").groupby("sequence_id"):
            assert (seq["offset"].to_numpy() == np.r_[0, seq["length"].cumsum()[:-1]]).all()
            size = int(seq["length"].sum())
            assert size == packing.WINDOW or size & (size - 1) == 0
        got, held = collections.Counter(), {}
        for r in pieces.sort_values(["sequence_id", "offset"]).itertuples():
            key = None if pd.isna(r.doc_id) else int(r.doc_id)
            ids = np.frombuffer(r.ids, dtype="<u4").tolist()
            assert len(ids) == r.length
            so_far = held.pop(key, []) if r.start else []
            assert len(so_far) == r.start
            so_far = so_far + ids
            if len(so_far) == r.doc_tokens:
                got[key, tuple(so_far)] += 1
            else:
                held[key] = so_far
        assert got == want and not held


@given(st.lists(st.integers(1, 9000), max_size=20))
@settings(max_examples=60, deadline=None)
def test_cut_points_tile_the_stream(sizes):
    total, at, seen = sum(sizes), 0, collections.defaultdict(list)
    for n in sizes:
        start = 0
        for s, k, q, o in packing.cut_points(at, n, total):
            assert s == start and k > 0
            start += k
            seen[q].append((o, k))
        assert start == n
        at += n
    for q, parts in seen.items():
        end = 0
        for o, k in sorted(parts):
            assert o == end
            end += k
        assert end <= packing.WINDOW and (end == packing.WINDOW or end & (end - 1) == 0)


# ------------------------------------------------------------------ 7 language model


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((0, 10), (1, 1), (5, 3), (1000, 10), (1000, 1 << 40), (5000, 1 << 62), (300, 300)):
        v = np.sort(rng.integers(0, u, n).astype(np.uint64))
        s = Sequence.build(v)
        parts = read_arrays(np.frombuffer(write_arrays({p: getattr(s, p) for p in Sequence.PARTS}), dtype=np.uint8))
        s = Sequence(*(parts[p] for p in Sequence.PARTS))
        if n:
            assert (s.access(np.arange(n)) == v).all()
        q = np.concatenate([v, rng.integers(0, u + 2, 500).astype(np.uint64), v + np.uint64(1)])
        i, same = s.successor(q)
        assert (i == np.searchsorted(v, q)).all() and (same == np.isin(q, v)).all()


def test_language_model_matches_brute_force(spark, tiny):
    table = common.read_table(spark, tiny, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (10**6, ""), (3, "the the")], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in table.collect()]
    out = ngram_model.score(table).collect()
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in rows]
    tokens = [(t or "").encode().lower().split() + [b"\n"] for _, t in rows]
    c, pairs = collections.Counter(), collections.Counter()
    for h, t in zip(held, tokens):
        if not h:
            c.update(t)
            pairs.update(zip(t, t[1:]))
    total, v = sum(c.values()), len(c)
    kept = {k: n for k, n in pairs.items() if n >= ngram_model.LEAST}
    share = collections.Counter()
    for (u, _), n in kept.items():
        share[u] += (n - ngram_model.DISCOUNT) / c[u]
    want = []
    for (i, _), h, t in zip(rows, held, tokens):
        base = model = 0.0
        for k, w in enumerate(t):
            p = (c[w] + 0.5) / (total + 0.5 * (v + 1))
            base += math.log10(p)
            if k and c[t[k - 1]]:
                p = max(kept.get((t[k - 1], w), 0) - ngram_model.DISCOUNT, 0) / c[t[k - 1]] + (1 - share[t[k - 1]]) * p
            model += math.log10(p)
        want.append((str(i), h, len(t), sum(c[w] > 0 for w in t), total, round(base, 6), model))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in out]
    for a, b in zip(sorted(want), sorted(got), strict=True):
        assert a[:6] == b[:6] and abs(a[6] - b[6]) < 2e-4 * a[2] + 1e-6


# ------------------------------------------------------------------ 8 chat


control = st.text(alphabet=st.sampled_from(list("<|>\\[]/sINTSYé\n ")), max_size=20) | st.lists(st.sampled_from(["<|turn|>", "<|end|>\n", "</s>", "[INST]", "[/INST]", "<s>", "\\", "<", "a"]), max_size=6).map("".join)


@given(control)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]"))


def test_rewritten_history_is_found():
    def template(turns):
        return "".join(f"[{r}:{t if i == len(turns) - 1 else t.upper()}]" for i, (r, t) in enumerate(turns))

    r = chat.Renderer(template)
    flags = [r.add("user", "hello")[-1], r.add("assistant", "yes")[-1]]
    assert flags == [False, True]


def test_chat_digests(spark, tiny):
    rows = [(i, k, role, t) for i, k, role, t in common.read_table(spark, tiny, "conversations").select("conv_id", "turn", "role", "text").toPandas().itertuples(index=False)]
    more = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    odd = [(900, 0, "user", None), (900, 0, "assistant", "x"), (900, 0, "assistant", "x"), (901, k := 0, "assistant", "turn " * 50)] + [(902, k, "assistant" if k % 2 else "user", f"t{k} <|end|>") for k in range(100)]
    frame = spark.createDataFrame([tuple(map(lambda x: None if x is None else (int(x) if not isinstance(x, str) else x), r)) for r in rows + more + odd], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(frame)).collect()}
    groups = collections.defaultdict(list)
    for i, k, role, t in rows + more + odd:
        groups[i].append((k, role, t or ""))
    assert set(got) == set(groups)
    for i, turns in groups.items():
        turns.sort()
        assert got[i].n_turns == len(turns)
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[i].loss_chars == len(loss) and got[i].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[i].formatted_chars == len(chat.marked_turns([(r, t) for _, r, t in turns]))


# ------------------------------------------------------------------ 9 vectors


def brute_neighbours(rows, queries, k=10):
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    out = {}
    for q, v in queries:
        d = np.sqrt(((m - np.array(v, dtype=float)) ** 2).sum(1))
        d[ids == q] = np.inf
        order = np.lexsort((ids, d))[:k]
        out[q] = [(int(ids[j]), d[j]) for j in order if np.isfinite(d[j])]
    return out


def test_neighbours_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    queries = [(i, v) for i, v in rows if i % 20 == 0]
    want = brute_neighbours(rows, queries)
    got = collections.defaultdict(dict)
    for r in multi_index.search(table, table.where("vec_id % 20 = 0"), share=0.6).collect():
        got[r.query_id][r.vec_id] = r.score
    recall = np.mean([len({i for i, _ in want[q]} & set(got[q])) / len(want[q]) for q in want])
    assert recall >= 0.9
    for q, found in got.items():
        for i, d in want[q]:
            assert i not in found or abs(found[i] - d) < 1e-12


def test_neighbours_odd_rows(spark):
    rng = np.random.default_rng(2)
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, same) for i in range(30)] + [(100 + i, rng.normal(size=4).tolist()) for i in range(40)]
    bad = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 2.0, 3.0]), (203, [float("nan"), 1.0, 1.0, 1.0]), (204, [float("inf"), 1.0, 1.0, 1.0]), (205, [1.0]), (None, same)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("vector", F.lit("v"))
    got = collections.defaultdict(list)
    for r in multi_index.search(frame, frame.where("vec_id % 10 = 0 or vec_id is null")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_neighbours(rows, [(i, v) for i, v in rows if i % 10 == 0])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert multi_index.search(frame.where("false"), frame).count() == 0


# ------------------------------------------------------------------ 6 URLs


def brute_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_url_rules(spark, small):
    extra = ["http://A.COM", "http://a.com/", "https://www.example.com/en/x", "https://x.www.example.com/en/", "http://example.com/en", "http://net/es/1", "http://xnet/es/1", "http://a.net/fr/?q=1", "no scheme", "", None, "http://", "x://a.com/b://c.net/es/", "http://a.org/a\nb#c"]
    table = common.read_table(spark, small, "pages").select("page_id", "url").unionByName(spark.createDataFrame([(10**6 + i, u) for i, u in enumerate(extra)] + [(None, "http://b.com/")], "page_id long, url string"))
    given_urls = collections.Counter((r.page_id, *brute_rule(r.url)) for r in table.collect())
    out = urls.judge(table).collect()
    got = collections.Counter((r.page_id, r.host, r.path, (r.rule, r.verdict) if r.rule else None) for r in out)
    assert got == given_urls and {r.verdict for r in out} == {"allow", "block"}
    assert urls.judge(table.where("false")).count() == 0


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = urls.boost(x[:2000], y[:2000])
    assert ((model.log_odds(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95


# ------------------------------------------------------------------ 4 quality


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    out = quality.op4(spark, sf).toPandas().set_index("doc_id")
    marks = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    held = out[out["held_out"]].join(marks, how="inner")
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.index] == out["held_out"].tolist()
    rank = held["score"].rank()
    pos = held["quality"] == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.9, auc


def test_quality_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(odd, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (4, 1), (None, 0), (6, None)], "doc_id long, quality int")
    assert quality.classify(odd, one).count() == odd.count()
    assert quality.classify(odd.where("false"), one).count() == 0


# ------------------------------------------------------------------ 1 language


def test_language_on_declared(spark, small):
    table = common.read_table(spark, small, "documents")
    out = language.identify(table).toPandas().set_index("doc_id")
    told = table.select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    assert (out["language"] == told.reindex(out.index)).mean() > 0.97
    assert out["accepted"].mean() > 0.97
    # the text decides where nothing else is known
    blind = language.identify(table.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))), host_col=None).toPandas().set_index("doc_id")
    unknown = blind[blind.index % 2 == 1]
    assert (unknown["language"] == told.reindex(unknown.index)).mean() > 0.95


def test_language_priors_by_hand(spark):
    """Short ambiguous texts lean on host, suffix and declaration."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["the", "and", "house"], k=30)), "en", f"http://www{i % 3}.one.uk/a") for i in range(40)]
    rows += [(100 + i, " ".join(rng.choices(["les", "des", "maison"], k=30)), "fr", f"http://h{i % 3}.deux.fr/b") for i in range(40)]
    rows += [(500, "zq", None, "http://www1.one.uk/"), (501, "zq", None, "http://h1.deux.fr/"), (502, "xv", "fr", None), (503, "zq", None, "http://new.fr/"), (504, "123 !!", "en", "http://www1.one.uk/"), (505, None, "fr", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string")
    got = {r.doc_id: r for r in language.identify(frame, host_col=None, url_col="url", threshold=0.4).collect()}
    assert [got[i].language for i in (500, 501, 502, 503)] == ["en", "fr", "fr", "fr"]
    assert not got[504].accepted and not got[505].accepted and got[505].language == "und"


def test_language_odd_rows(spark, odd):
    out = language.identify(odd)
    assert out.count() == odd.count()
    assert language.identify(odd.where("false")).count() == 0
    kept = language.keep_identified(odd)
    assert kept.columns == odd.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {4, 5, None} <= ids and not ids & {1, 2, 3}


def test_empty_tables(spark, odd):
    none = odd.where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    assert lines.line_matches(none).count() == 0
    assert decontaminate.leaks(odd, bench).count() == 0
    assert decontaminate.leaks(none, bench).count() == 0
    assert packing.pack(none).count() == 0
    assert ngram_model.score(none).count() == 0
    assert chat.digests(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
