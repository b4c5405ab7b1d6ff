"""Long lines of frequent words: keys in line with their words, matches as in brute force."""

import random

import numpy as np
import pytest

from quorate.llm import common, lines, setjoin


def test_keys_grow_in_line_with_a_line():
    for n in (65, 1_000, 20_000):
        size = int(setjoin.prefix_length(np.array([n]), 0.8)[0]) + 1
        key, position, owner = setjoin._keys(np.arange(size, dtype=np.uint32), np.array([0]), np.array([n]), np.array([0]), 0.8)
        assert len(key) == 2 * (size - 1) == len(position) == len(owner)


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_every_matching_pair_shares_a_key(threshold):
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.choice([rng.randrange(2, 30), rng.randrange(45, 70), rng.randrange(60, 90), rng.randrange(100, 500)])
        base = sorted(rng.sample(range(5 * n), 2 * n))
        a, b = set(rng.sample(base, n)), None
        cut = rng.randrange(0, int((1 - threshold) * n) + 1)
        b = set(sorted(a)[: n - cut]) | set(rng.sample(range(5 * n, 10 * n), rng.randrange(0, int((1 - threshold) * n) + 1)))
        if a == b or len(a & b) < threshold * len(a | b):
            continue
        sides, limit = [], rng.randrange(0, 5 * n)  # members from ``limit`` on are frequent, and come last
        for s in (sorted(a), sorted(b)):
            m = np.array(s, dtype=np.uint32)
            size = min(int(setjoin.prefix_length(np.array([len(m)]), threshold)[0]) + 1, len(m))
            rare = int((m[:size] < limit).sum())
            sides.append(set(setjoin._keys(m[:size], np.array([0]), np.array([len(m)]), np.array([rare]), threshold)[0].tolist()))
        assert sides[0] & sides[1], (len(a), len(b), limit)


def test_long_lines_are_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(260)]
    texts = []
    for _ in range(60):
        base = rng.sample(vocabulary, rng.choice([50, 62, 66, 80, 180]))
        texts.append(" ".join(base))
        for _ in range(2):
            w = [x for x in base if rng.random() > 0.1] + rng.sample(vocabulary, 3)
            rng.shuffle(w)
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.links, r.removed, r.match_doc_id) for r in lines.line_matches(docs, frequent=2).collect()}
    sets = [frozenset(t.split()) for t in texts]
    for i, s in enumerate(sets):
        near = [j for j, z in enumerate(sets) if len(s & z) >= 0.8 * len(s | z) - 1e-9]
        assert got[i] == (len({sets[j] for j in near} - {s}), min(near) < i, min(near))
    assert common.BATCH
