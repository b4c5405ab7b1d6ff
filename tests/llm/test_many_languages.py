"""Language ID with more declared languages than the model once held."""

import random

from quorate.llm import language


def test_rare_and_regional_declarations(spark):
    rng = random.Random(4)
    rows, names = [], [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqrs"]
    vocabulary = {n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for n in names}
    for k, n in enumerate(names):
        for j in range(2 if k == 70 else 3):
            rows.append((len(rows), " ".join(rng.choices(vocabulary[n], k=40)), f"{n}-{'XY'[j % 2]}" if k % 2 else f"{n.upper()}_zz", "h"))
    rows.append((len(rows), " ".join(rng.choices(vocabulary[names[70]], k=40)), None, "h"))
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(names) > 64 and got[len(rows) - 1].language == names[70] and got[len(rows) - 1].accepted
    assert {r.language for r in got.values()} == set(names)


def test_junk_declarations_have_no_model(spark):
    """Declarations under the smallest share are missing evidence: their rows are judged by text."""
    rng = random.Random(9)
    vocabulary = {n: ["".join(rng.choices(letters, k=6)) for _ in range(12)] for n, letters in (("en", "abcdefghijklm"), ("de", "nopqrstuvwxyz"))}
    rows = [(k, " ".join(rng.choices(vocabulary["de" if k % 2 else "en"], k=40)), "de" if k % 2 else "en", "h") for k in range(100)]
    rows += [(100 + k, " ".join(rng.choices(vocabulary["de" if k % 2 else "en"], k=40)), f"junk{k}", "h") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names, logs = language.fit(docs, "text", "lang", "doc_id", smallest=0.05)
    assert names == ["de", "en", language.UNKNOWN] and len(logs) == 3
    got = {r.doc_id: r for r in language.identify(docs, smallest=0.05).collect()}
    assert len(got) == 160 and all(r.language == ("de" if k % 2 else "en") and r.accepted for k, r in got.items())
    every = {r.doc_id: r for r in language.identify(docs.where("doc_id >= 100"), smallest=0.5).collect()}
    assert {(r.language, r.accepted) for r in every.values()} == {(language.UNKNOWN, False)}  # no declaration has half of the rows
