"""Line dedup: exact set-similarity join of the lines of all documents.

A line is the set of its words (A-Z lower-cased, cut at ASCII white space); lines
without words are never compared or removed.  Two lines match when the Jaccard similarity of their
sets is at least ``threshold``.  Lines are ordered by document id, then line
number; a line is removed when an earlier line matches it.

Method.  Words are ordered by rarity, which a fixed-size sketch of all words of the corpus gives.
A line is entered under the words of its prefix; two matching lines share one there.  A word
that is frequent in the whole corpus is entered together with a second word of the prefix made one
word longer (two matching lines share two words there), so that common words don't gather long
lists; a line of more than ``setjoin.SHORT`` words enters it with its size band instead, so keys grow in line with
a line's words.  Lines that meet are filtered by length, by the position of the shared word and by a
bitmap, as ``setjoin`` says; what passes joins one component, and inside of a component all lines are
verified on their words and their matches counted where they meet, so no pair leaves a
task.  Equal sets are one class from the start, and only classes are joined; sets so short that one
more word is below the threshold match equal sets only and aren't entered.

Defined results: null and empty texts have no lines to compare; rows without an id take no part
and keep their text; rows that repeat an id are told apart by their text, and fully repeated rows
share each decision; an empty table gives an empty result; other columns don't matter.  Lines match
by 64-bit word hashes; see ``setjoin`` for the chance that two sets pass for one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, setjoin

THRESHOLD = 0.8
#: Words that occur more often in the corpus are entered in pairs.
FREQUENT = 1000
#: Groups of at most so many lines are verified pair by pair, larger ones as one product of matrices.
FEW = 6
#: Words of a group that one product takes at a time.
COLUMNS = 1024
#: Text that a task verifies at a time.
PIECE = 2 << 20
#: Components of more lines are linked again with bitmaps of WIDE longs: 64 bits say little of long lines.
LARGE = 128
WIDE = 8
CLASS = ["signature", "n", "parity"]


def read_lines(column: pa.Array, scale: np.ndarray, width: int = 1) -> dict:
    """The lines of a text column that have words, as word sets in order of rarity."""
    raw, offsets = setjoin.raw_text(column)
    starts, hashes = setjoin.words(raw, offsets)
    breaks = np.flatnonzero(raw == 10)
    per_row = np.bincount(np.searchsorted(offsets, breaks, side="right") - 1, minlength=len(column)) + 1
    first = np.cumsum(per_row) - per_row
    opens = np.empty(int(per_row.sum()), dtype=np.int64)
    inner = np.ones(len(opens), dtype=bool)
    inner[first] = False
    opens[first], opens[inner] = offsets[:-1], breaks + 1
    per_line = np.diff(np.searchsorted(starts, np.r_[opens, len(raw)]))
    line = np.repeat(np.arange(len(opens)), per_line)
    line, word, rank = setjoin.distinct_sorted(line, hashes, setjoin.rank_of(hashes, scale))
    n = np.bincount(line, minlength=len(opens))
    kept, ends = np.flatnonzero(n), np.cumsum(n)
    signature, parity = setjoin.describe(word, ends[kept], n[kept], width)
    row = np.searchsorted(first, kept, side="right") - 1
    return {"kept": kept, "row": row, "number": kept - first[row], "n": n[kept], "starts": (ends - n)[kept], "signature": signature.view(np.int64), "parity": parity, "word": word, "rank": rank}


def _common_from(frequent: int) -> int:
    return int(setjoin.ranks(np.array([frequent]))[0]) if frequent > 0 else -1


def line_table(docs: DataFrame, counts: np.ndarray, threshold: float = THRESHOLD, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, copy, line_no, signature, n, parity, line, rare, prefix) from (doc_id, copy, text).

    The last two are null where the task has seen the same set just before, and for sets too short
    to match any other.
    """
    sketch = docs.sparkSession.sparkContext.broadcast(setjoin.ranks(counts))  # fixed size
    common_from = _common_from(frequent)
    schema = "doc_id long, copy long, line_no int, signature long, n int, parity long, line string, rare int, prefix array<int>"

    @common.tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, seen = sketch.value, set()
        for batch in batches:
            for lo, hi in common.pieces(batch, "text", PIECE):
                column = batch.column("text").slice(lo, hi - lo)
                got = read_lines(column, scale)
                if not len(got["kept"]):
                    continue
                known, at = np.unique(got["signature"], return_index=True)
                new = np.zeros(len(got["n"]), dtype=bool)
                new[at] = [s not in seen for s in known.tolist()]
                seen.update(known.tolist())
                if len(seen) > 200_000:
                    seen.clear()  # only saves repeats; they are taken out where they meet
                n = got["n"]
                new &= n >= threshold * (n + 1) - 1e-9
                chosen = np.flatnonzero(new)
                prefix, rare = setjoin.prefixes(got["word"], got["rank"], got["starts"][chosen], n[chosen], threshold, common_from)
                place = np.cumsum(new) - 1
                take, mine = pa.array(got["row"] + lo), pa.array(place, mask=~new)
                lines = pc.split_pattern(column.fill_null(""), "\n").flatten().take(pa.array(got["kept"]))
                columns = [
                    batch.column("doc_id").take(take), batch.column("copy").take(take), pa.array(got["number"], pa.int32()), pa.array(got["signature"]), pa.array(n, pa.int32()), pa.array(got["parity"][:, 0].view(np.int64)), lines.cast(pa.string()),
                    pa.array(rare, pa.int32()).take(mine), prefix.take(mine),
                ]
                yield pa.record_batch(columns, names=["doc_id", "copy", "line_no", "signature", "n", "parity", "line", "rare", "prefix"])

    return docs.mapInArrow(read, schema)


def _alike(shared: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return shared / (a + b - shared) >= threshold - 1e-12


def _few(row: np.ndarray, word: np.ndarray, n: np.ndarray, size: np.ndarray, first: np.ndarray, block: np.ndarray, apart: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Matching pairs (x, y) of rows of small groups, x < y; a group's rows lie one after another."""
    index = np.arange(len(n))
    after = np.where(size <= FEW, first + size - index - 1, 0)
    x = np.repeat(index, after)
    y = common.gather_ranges(index + 1, after)
    ok = (np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]) - 1e-9) & (~apart[x] | (block[x] != block[y]))
    x, y = x[ok], y[ok]
    starts = np.cumsum(n) - n
    pair = np.r_[np.repeat(np.arange(len(x)), n[x]), np.repeat(np.arange(len(x)), n[y])]
    at = np.r_[common.gather_ranges(starts[x], n[x]), common.gather_ranges(starts[y], n[y])]
    both = np.sort(pair * (int(word.max(initial=0)) + 1) + word[at])
    shared = np.bincount(both[1:][both[1:] == both[:-1]] // (int(word.max(initial=0)) + 1), minlength=len(x))
    ok = _alike(shared, n[x], n[y], threshold)
    return x[ok], y[ok]


def _many(row: np.ndarray, word: np.ndarray, left: np.ndarray, right: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each left row of a group matches each right one, by products of their membership matrices."""
    known, column, held = np.unique(word, return_inverse=True, return_counts=True)
    often = held > 1  # a word of one line is shared by none
    place = np.cumsum(often) - 1
    row, column = row[often[column]], place[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    side = [np.full(len(n), -1), np.full(len(n), -1)]
    side[0][left], side[1][right] = np.arange(len(left)), np.arange(len(right))
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    for lo in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        r, c = row[a:b], column[a:b] - lo
        sets = []
        for s, size in zip(side, (len(left), len(right)), strict=True):
            matrix, own = np.zeros((size, COLUMNS), dtype=np.float32), s[r] >= 0
            matrix[s[r[own]], c[own]] = 1
            sets.append(matrix)
        shared += sets[0] @ sets[1].T
    return _alike(shared, n[left][:, None], n[right][None, :], threshold)


def count_links(batch: pa.RecordBatch, threshold: float) -> pa.RecordBatch:
    """(signature, n, parity, links, doc_id, line_no, copy) of the lines of whole groups that match another line there.

    The last three are the earliest of the matching lines.
    """
    names = ["root", "i", "j", "block", "signature", "n", "parity", "doc_id", "line_no", "copy"]
    cols = {c: batch.column(c).to_numpy() for c in names}
    order = np.lexsort([cols[c] for c in ("parity", "n", "signature", "j", "i", "root")])
    same = np.r_[False, np.all([cols[c][order][1:] == cols[c][order][:-1] for c in ("root", "i", "j", "signature", "n", "parity")], axis=0)]
    order = order[~same]  # fully repeated rows name one line
    cols = {c: v[order] for c, v in cols.items()}
    hashes, bounds = setjoin.text_words(batch.column("line").take(pa.array(order)))
    row, word, _ = setjoin.distinct_sorted(np.repeat(np.arange(len(order)), np.diff(bounds)), hashes)
    _, word = np.unique(word, return_inverse=True)
    n = np.bincount(row, minlength=len(order))
    opens = np.flatnonzero(np.r_[True, np.any([cols[c][1:] != cols[c][:-1] for c in ("root", "i", "j")], axis=0)])
    sizes = np.diff(np.r_[opens, len(order)])
    size, first = np.repeat(sizes, sizes), np.repeat(opens, sizes)
    by_place = np.lexsort((cols["copy"], cols["line_no"], cols["doc_id"]))
    when = np.empty(len(order), dtype=np.int64)
    when[by_place] = np.arange(len(order))
    links, least = np.zeros(len(order), dtype=np.int64), np.full(len(order), len(order))
    apart = cols["i"] != cols["j"]
    x, y = _few(row, word, n, size, first, cols["block"], apart, threshold)
    for a, b in ((x, y), (y, x)):
        links += np.bincount(a, minlength=len(order))
        np.minimum.at(least, a, when[b])
    starts = np.r_[0, np.cumsum(n)]
    for g in np.flatnonzero(sizes > FEW):
        lo, hi = opens[g], opens[g] + sizes[g]
        part = slice(starts[lo], starts[hi])
        index = np.arange(hi - lo)
        if apart[lo]:
            halves = [np.flatnonzero(cols["block"][lo:hi] == cols[k][lo]) for k in ("i", "j")]
        else:
            halves = [index, index]
        if not len(halves[0]) or not len(halves[1]):
            continue
        found = _many(row[part] - lo, word[part], *halves, n[lo:hi], threshold)
        if not apart[lo]:
            np.fill_diagonal(found, False)
        for k, matrix in ((0, found), (1, found.T)):
            if k and not apart[lo]:
                break
            for p in range(0, len(matrix), 512):
                some = matrix[p : p + 512]
                at = lo + halves[k][p : p + 512]
                links[at] += some.sum(axis=1)
                least[at] = np.minimum(least[at], np.where(some, when[lo + halves[1 - k]][None, :], len(order)).min(axis=1))
    some = np.flatnonzero(links)
    other = by_place[least[some]]
    out = [cols[c][some] for c in CLASS] + [links[some]] + [cols[c][other] for c in ("doc_id", "line_no", "copy")]
    return pa.record_batch([pa.array(c) for c in out], names=[*CLASS, "links", "doc_id", "line_no", "copy"])


def wide_table(rows: DataFrame, counts: np.ndarray, threshold: float, frequent: int) -> DataFrame:
    """(signature, n, parity, rare, prefix) of single lines, with bitmaps of WIDE longs."""
    sketch = rows.sparkSession.sparkContext.broadcast(setjoin.ranks(counts))  # fixed size
    common_from = _common_from(frequent)

    @common.tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in common.pieces(batch, "line", PIECE):
                got = read_lines(batch.column("line").slice(lo, hi - lo), sketch.value, WIDE)
                prefix, rare = setjoin.prefixes(got["word"], got["rank"], got["starts"], got["n"], threshold, common_from)
                yield pa.record_batch([pa.array(got["signature"]), pa.array(got["n"], pa.int32()), setjoin.as_binary(got["parity"]), pa.array(rare, pa.int32()), prefix], names=["signature", "n", "parity", "rare", "prefix"])

    return rows.select("line").mapInArrow(read, "signature long, n int, parity binary, rare int, prefix array<int>")


def _sized(members: DataFrame) -> DataFrame:
    """``members`` with the size of their component, written in their place."""
    sizes = members.groupBy("root").agg(F.count("*").alias("size")).withColumnRenamed("root", "root_")
    out = common.materialise(members.join(sizes, F.col("root") == F.col("root_")).select("s", "root", "size"), "line-groups")
    common.discard(members)
    return out


def groups(table: DataFrame, counts: np.ndarray, threshold: float, frequent: int) -> DataFrame:
    """(s, root, size): every signature that may match another one, and its component."""
    sized = _sized(setjoin.members(setjoin.linked(table, threshold, 1), "line-groups"))
    large = sized.where(F.col("size") > LARGE).select("s")
    if large.isEmpty():
        return sized
    large = common.materialise(large, "large-groups")
    rows = table.where("prefix is not null").select("signature", "line").join(common.small_side(large), F.col("signature") == F.col("s"), "left_semi")
    again = common.materialise(wide_table(rows, counts, threshold, frequent), "wide-sets")
    finer = _sized(setjoin.members(setjoin.linked(again, threshold, WIDE), "line-groups"))
    return sized.where(F.col("size") <= LARGE).unionByName(finer)


def partners(table: DataFrame, firsts: DataFrame, sized: DataFrame, threshold: float) -> DataFrame:
    """(signature, n, parity, links, other) of the classes that match another one: how many, and the earliest line of those."""
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["doc_id", "line_no", "copy"]
    involved = firsts.join(sized, F.col("signature") == F.col("s")).select("root", "size", *CLASS, *(F.col(f"first.{c}").alias(c) for c in place))
    texts = table.select("signature", *place, "line").join(common.small_side(sized.select("s")), F.col("signature") == F.col("s"), "left_semi")
    rows = involved.join(texts, ["signature", *place])
    dealt = setjoin.in_blocks(rows, "signature", F.greatest(F.lit(1), F.ceil(F.col("size") / setjoin.BLOCK)))
    dealt = dealt.select("root", "i", "j", "block", *CLASS, *place, "line").repartition(tasks, "root", "i", "j").sortWithinPartitions("root", "i", "j")

    @common.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in setjoin.grouped(batches, PIECE, "line"):
            yield count_links(batch, threshold)

    counted = dealt.mapInArrow(count, "signature long, n int, parity long, links long, doc_id long, line_no int, copy long")
    return counted.groupBy(*CLASS).agg(F.sum("links").alias("links"), F.min(F.struct(*place)).alias("other"))


def line_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, frequent: int = FREQUENT) -> DataFrame:
    """One row per compared line: doc_id, copy, line_no, class_id, n_words, links, match_doc_id, match_line_no, removed.

    class_id names the line's word set and links counts the other sets that match it; match_* is
    the earliest line that the line matches, itself included.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null").withColumn("copy", F.xxhash64("text"))
    counts = setjoin.member_counts(rows, lambda column: setjoin.text_words(column)[0])
    table = common.materialise(line_table(rows.select("doc_id", "copy", "text"), counts, threshold, frequent), "line-sets")
    place = F.struct("doc_id", "line_no", "copy")
    firsts = common.materialise(table.groupBy(*CLASS).agg(F.min(place).alias("first")), "first-lines")
    matched = partners(table, firsts, groups(table, counts, threshold, frequent), threshold)
    known = firsts.join(matched, CLASS, "left").select(*CLASS, F.coalesce("links", F.lit(0)).alias("links"), F.least("first", "other").alias("match"))
    known = common.materialise(known, "line-classes")  # so that a hot class can be split where lines join it
    common.discard(firsts)
    out = table.select("doc_id", "copy", "line_no", *CLASS).join(known, CLASS)
    # repeated rows of one document share their place, so neither is later than the other
    removed = F.col("match") < F.struct("doc_id", "line_no", "copy")
    return out.select("doc_id", "copy", "line_no", F.col("signature").alias("class_id"), F.col("n").alias("n_words"), "links", F.col("match.doc_id").alias("match_doc_id"), F.col("match.line_no").alias("match_line_no"), removed.alias("removed"))


def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines of those numbers, in time linear in the text."""
    out = [None] * len(texts)
    for k, (text, numbers) in enumerate(zip(texts, gone, strict=True)):
        if text is not None and numbers is not None:
            numbers = set(numbers.tolist())
            out[k] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in numbers)
    return pd.Series(out, dtype=object)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the removed lines taken out of the text; a document left without words is dropped."""
    gone = line_matches(docs, id_col, text_col, threshold).where("removed").select("doc_id", "copy", "line_no").distinct()
    gone = gone.groupBy("doc_id", "copy").agg(F.collect_list("line_no").alias("lines"))
    names = [common.free_name(docs, n) for n in ("__id", "__copy", "__gone", "__kept")]
    gone = common.small_side(common.materialise(gone.toDF(*names[:3]), "removed-lines"), 200_000)
    text, removed = docs[text_col], gone[names[2]]
    joined = docs.join(gone, (docs[id_col].cast("long") == gone[names[0]]) & (F.xxhash64(F.coalesce(text, F.lit(""))) == gone[names[1]]), "left")
    cut = F.pandas_udf(_without, "string")(F.when(removed.isNotNull(), text), removed)
    joined = joined.withColumn(names[3], cut)
    kept = F.when(removed.isNull(), text).otherwise(F.col(names[3]))
    out = joined.where(removed.isNull() | F.col(names[3]).rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*(kept.alias(c) if c == text_col else docs[c] for c in docs.columns))


def op10(spark, sf_dir: str) -> DataFrame:
    return line_matches(common.read_table(spark, sf_dir, "documents"))
