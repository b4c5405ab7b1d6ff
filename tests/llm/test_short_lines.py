"""Line dedup of lines of few words."""

import random

from quorate.llm import lines


def matches(a, b):
    return len(a & b) / len(a | b) >= 0.8


def test_short_lines_match_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(9)]
    rows = [(i, "\n".join(" ".join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(4))) for i in range(60)]
    rows += [(100, "All rights reserved."), (101, "spam spam spam spam spam spam"), (102, "all  RIGHTS reserved.\nmore"), (103, "spam spam\n\n \nspam " * 3), (104, "a b c d"), (105, "e d c b a"), (106, "a b c"), (107, "a b c d f")]
    place = [(i, k, frozenset(x.lower().split())) for i, t in rows for k, x in enumerate(t.split("\n"))]
    want = {(i, k): any(matches(s, z) for j, m, z in place if z and (j, m) < (i, k)) for i, k, s in place if s}
    got = {(r.doc_id, r.line_no): r.removed for r in lines.line_matches(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want
    assert got[102, 0] and got[103, 0] and got[105, 0] and got[107, 0] and not got[106, 0]


def test_repeats_of_frequent_short_lines(spark):
    rows = [(i, f"All rights reserved.\nthe the the\nof the end now{' then' if i % 2 else ''}\nline{i} alone") for i in range(1200)]
    kept = {r.doc_id: r.text for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept[0] == rows[0][1] and kept[1] == "line1 alone" and kept[1199] == "line1199 alone"
