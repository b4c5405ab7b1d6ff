"""SimHash near-duplicate detection: binary trie self-join and connected components.

Signatures: texts are lower-cased (A-Z), cut into words at ASCII white space and into 3-word
shingles with repeats; a fingerprint bit is set when more than half of the shingles' XXH64 (seed
42) values have it.  A text of one or two words is one shingle; a text without words has
fingerprint zero and is linked like any other.

Links: distinct fingerprints within ``radius`` differing bits.  Two such fingerprints agree in at
least one of ``radius + 1`` bit blocks, so each fingerprint is dealt once per block by its block
value.  Inside a task the sorted fingerprints of every block value form a binary trie (a node is
a range of the sorted array); node pairs are traversed together from the roots, differing bits
accumulate, and a pair is pruned as soon as the error budget is exceeded.  Each trie yields a
spanning forest of its links, not all pairs, so copies and near-copies stay linear.

Components: large-star / small-star contraction on the link table, each round written to shared
storage.

Defined results: null text counts as empty; a null id gets a row, its component is the smallest
known id reachable or null; repeated rows each get a row; an empty table gives an empty result;
other input columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
BITS = 64
_CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of one UTF-8 text, as an unsigned 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : min(n, at + _CHUNK) + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))
        hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=len(part) - width + 1)
        counts += _bit_counts(hashes)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many values have each bit set, from the lowest bit up."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, copy, fp): copy is a hash of the text, fp the fingerprint's bit pattern in a signed long."""

    @common.tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows, dtype=np.uint64)
            for lo, hi in common.pieces(batch, "text"):
                for i, text in enumerate(common.text_bytes(batch.column("text").slice(lo, hi - lo)).to_pylist(), lo):
                    out[i] = fingerprint(text, width)
            yield pa.record_batch([batch.column("doc_id"), batch.column("copy"), pa.array(out.view(np.int64))], names=["doc_id", "copy", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.copy_of(F.col(text_col)).alias("copy"), F.col(text_col).alias("text"))
    return picked.mapInArrow(sign, "doc_id long, copy long, fp long")


# ---------------------------------------------------------------- trie self-join


def _cut(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First index in each sorted range whose ``bit`` is set; the bits above it are equal within a range."""
    left, right, mask = lo.copy(), hi.copy(), np.uint64(1 << bit)
    while (open_ := left < right).any():
        mid = (left + right) >> 1
        ones = open_ & ((values[np.minimum(mid, len(values) - 1)] & mask) != 0)
        right = np.where(ones, mid, right)
        left = np.where(open_ & ~ones, mid + 1, left)
    return left


def trie_self_join(groups: np.ndarray, values: np.ndarray, radius: int, shared: int = 0, leaf: int = 8, front: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of one group whose values differ in at most ``radius`` bits.

    ``values`` are sorted within the contiguous ``groups`` and distinct there; their ``shared`` top
    bits are equal within a group, so the traversal starts below them.  Pairs of trie nodes
    are expanded bit by bit in fronts of bounded size (depth first over fronts, breadth first
    inside one); a node pair of at most ``leaf`` by ``leaf`` values is compared directly.
    """
    if not len(values):
        return
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    ends = np.r_[starts[1:], len(values)]
    many = ends - starts > 1
    z = np.zeros(int(many.sum()), dtype=np.int64)
    stack = [(BITS - 1 - shared, starts[many], ends[many], starts[many], ends[many], z)]
    while stack:
        bit, a, b, c, d, err = stack.pop()
        if len(a) > front:
            half = len(a) // 2
            stack += [(bit, *(x[half:] for x in (a, b, c, d, err))), (bit, *(x[:half] for x in (a, b, c, d, err)))]
            continue
        done = ((b - a <= leaf) & (d - c <= leaf)) | (bit < 0)
        if done.any():
            yield from _leaves(values, a[done], b[done], c[done], d[done], radius)
            a, b, c, d, err = (x[~done] for x in (a, b, c, d, err))
        if not len(a):
            continue
        m, n = _cut(values, a, b, bit), _cut(values, c, d, bit)
        same = a == c  # a node paired with itself: its two children are crossed once only
        rows = [(a, m, c, n, err, None), (m, b, n, d, err, None), (a, m, n, d, err + 1, None), (m, b, c, n, err + 1, ~same)]
        kept = []
        for p, q, r, s, e, only in rows:
            ok = (p < q) & (r < s) & (e <= radius) & ((p != r) | (q - p > 1))
            if only is not None:
                ok &= only
            kept.append(tuple(x[ok] for x in (p, q, r, s, e)))
        joined = tuple(np.concatenate([k[i] for k in kept]) for i in range(5))
        if len(joined[0]):
            stack.append((bit - 1, *joined))


def _leaves(values, a, b, c, d, radius):
    """Compare the values of small node pairs, every pair of positions at once."""
    for i in range(int((b - a).max())):
        for j in range(int((d - c).max())):
            ok = (a + i < b) & (c + j < d) & ((a != c) | (i < j))
            x, y = a[ok] + i, c[ok] + j
            near = np.bitwise_count(values[x] ^ values[y]) <= radius
            if near.any():
                yield x[near], y[near]


class Forest:
    """Union-find over 0..n-1 with batched links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        while True:
            up = p[x]
            if (up == x).all():
                return x
            p[x] = p[up]
            x = p[x]

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            x, y = self.roots(x), self.roots(y)
            low, high = np.minimum(x, y), np.maximum(x, y)
            apart = low != high
            x, y = low[apart], high[apart]
            np.minimum.at(self.parent, y, x)


def fingerprint_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links that span every group of distinct fingerprints within ``radius`` bits, ``fps`` having column fp."""
    blocks = radius + 1
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]

    def rotate(values: np.ndarray, low: int) -> np.ndarray:
        return values if not low else (values >> np.uint64(low)) | (values << np.uint64(BITS - low))

    def keys(col, i):
        width = edges[i + 1] - edges[i]
        return F.shiftrightunsigned(col, edges[i]).bitwiseAND((1 << width) - 1)

    dealt = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("block"), keys(F.col("fp"), i).alias("part")) for i in range(blocks)))).alias("k"))
    dealt = dealt.select("fp", F.col("k.block").alias("block"), F.col("k.part").alias("part"))
    tasks = fps.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = dealt.repartition(int(tasks), "block", "part").sortWithinPartitions("block", "part")

    def join(rows: np.ndarray, block: int, part: np.ndarray):
        width, low = edges[block + 1] - edges[block], edges[block]
        top = rotate(rows, (low + width) % BITS)  # the shared block leads, so the trie's roots are its values
        order = np.lexsort((top, part))
        rows, part, top = rows[order], part[order], top[order]
        forest = Forest(len(rows))
        for x, y in trie_self_join(part, top, radius, width):
            forest.link(x, y)
        root = forest.roots(np.arange(len(rows)))
        moved = np.flatnonzero(root != np.arange(len(rows)))
        return rows[root[moved]], rows[moved]

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of whole block values go through the join together, an open run waits for its end."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def emit(block, part, fp):
            for k in np.unique(block):
                own = block == k
                a, b = join(fp[own], int(k), part[own])
                if len(a):
                    yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        size = 0
        for batch in batches:
            held.append((batch.column("block").to_numpy(), batch.column("part").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
            size += batch.num_rows
            if size >= 1 << 18:
                block, part, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                last = int(np.flatnonzero((block != block[-1]) | (part != part[-1])).max(initial=-1)) + 1
                if last:
                    yield from emit(block[:last], part[:last], fp[:last])
                held = [(block[last:], part[last:], fp[last:])]
                size = len(block) - last
        if size:
            yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.mapInArrow(traverse, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of the undirected links (a, b) the smallest node it reaches.

    Large-star then small-star until no link changes; each round is written to shared storage and
    the round before is removed.  Work per round is linear in the links, and rounds go on until
    nothing changes.
    """
    now = common.materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node go to its smallest neighbour (itself included)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: neighbours below a node and the node itself go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        after = common.materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        same = _digest(after) == _digest(now)
        common.discard(now)
        now = after
        if same:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(every row's doc_id and fp, every fp's smallest doc_id and the root of its component)."""
    signed = common.materialise(signatures(docs, id_col, text_col, width), "signatures")
    classes = common.materialise(signed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    mapped = components(fingerprint_links(classes.select("fp"), radius))
    # only linked fingerprints need the smallest id of their whole component
    return signed, classes.join(mapped, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    signed, rooted = _grouped(docs, id_col, text_col, width, radius)
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(lowest, "root").select(F.col("fp").alias("fp_"), "component_id")
    out = signed.join(named, F.col("fp") == F.col("fp_"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, copy, component) of every row: its text's hash and the name of its group."""
    signed, rooted = _grouped(docs, id_col, text_col, width, radius)
    named = rooted.select(F.col("fp").alias("fp_"), F.col("root").alias("component"))
    return signed.join(named, F.col("fp") == F.col("fp_")).select("doc_id", "copy", "component")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, see ``keep_first``."""
    return keep_first(docs, groups(docs, id_col, text_col, width, radius), id_col, text_col)


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group (doc_id, copy, component): the one of the smallest id.

    All columns stay.  Of texts that share the smallest id the one of the smallest hash stays, and
    of rows that repeat id and text one; rows without an id stay, as no group decision can name them.
    """
    found = groups.where("doc_id is not null").groupBy("doc_id", "copy", "component").agg(F.count("*").alias("n"))
    found = common.materialise(found, "groups")
    best = found.groupBy(F.col("component").alias("c")).agg(F.min(F.struct("doc_id", "copy")).alias("best"))
    judged = found.join(best, F.col("component") == F.col("c")).select("doc_id", "copy", "n", (F.struct("doc_id", "copy") == F.col("best")).alias("stays"))
    gone = common.materialise(judged.where("not stays or n > 1"), "gone")
    kept = common.by_copy(docs, id_col, text_col, gone, "left_anti")
    # rows that stay but are repeated: taken out above, and brought back once
    repeated = common.materialise(gone.where("stays"), "repeated")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(common.by_copy(docs, id_col, text_col, repeated, "left_semi").dropDuplicates([id_col, text_col]))


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read_table(spark, sf_dir, "documents"))
