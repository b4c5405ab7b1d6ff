"""Pairs that training saw once."""

import zlib

from quorate.llm import ngram_model


def test_pairs_seen_once_count(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]
    train = [i for i in range(100) if i not in held]
    rows = [(train[0], "red fox"), (train[1], "blue owl"), (held[0], "red fox"), (held[1], "red owl")]
    got = {r.doc_id: r for r in ngram_model.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen, unseen = got[held[0]], got[held[1]]
    assert seen.held_out and unseen.held_out and abs(seen.base_score - unseen.base_score) < 1e-9
    assert seen.score > unseen.score + 0.1
