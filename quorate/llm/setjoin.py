"""Exact set-similarity joins: what the joins of lines and of documents share.

A set is known by its size ``n``, the sum of its members' mixed hashes (``signature``), a bitmap
that holds the parity of the members of each hash bit (``parity``) and its ``prefix``: its first
members in a fixed order, one more than the prefix filter needs.  Two sets that reach the threshold
share a member of their prefixes.  Members are named by 64-bit hashes; a set is named by signature,
parity and size, so two of m different sets pass for one with a probability below m**2 / 2**100.

``linked`` enters every set under the members of its prefix, in packed blocks that need no sort and
no rows of their own, and joins sets that meet in a union-find forest after the filters by length, by
position and by bitmap (two sets differ in at least as many members as their bitmaps in bits).  One
row per set and key leaves a task at most, never a pair.  Connected components of these links
hold every pair that reaches the threshold, so each set goes to its component once and is verified
there.  A component above ``BLOCK`` sets is dealt in blocks, of which each two meet in one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

#: Counters of the sketch that orders members by rarity; its collisions cost time and never results.
SKETCH_BITS = 20
#: Set sizes that fit the packed entries; larger sets pass the filters and are verified.
LONGEST = 65_535
#: Members up to which a set enters its frequent members in pairs.
SHORT = 64
#: Sets of a component that are verified in one group.
BLOCK = 2048
#: Entries that a task packs at a time.
FLUSH = 2_000_000
#: Steps after which runs of sets that are mostly connected are finished directly.
LOOKS = {17 * 8**k for k in range(8)}
#: Bytes that are hashed at a time, so that their arrays stay in a core's cache.
_STEP = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums and pairs of hashes spread."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _values() -> np.ndarray:
    """A 64-bit value of each byte, A-Z as a-z; zero for ASCII white space."""
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    lower[list(common.ASCII_SPACE)] = 32
    value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    value[32] = 0
    return value[lower]


def _solid(part: np.ndarray) -> np.ndarray:
    return (part != 32) & (part - np.uint8(9) > 4)


_VALUE = _values()
_BASE = 0xD1342543DE82EF95  # odd, so its powers have inverses


def _powers(base: int) -> np.ndarray:
    """The first powers of ``base`` modulo 2**64, one for each byte of a block."""
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(_STEP - 1, base, dtype=np.uint64)])


_POWERS, _INVERSES = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, row offsets in them) of a string column; nulls are empty."""
    column = common.text_bytes(column)
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of every word between ASCII white space, A-Z lower-cased.

    A hash is a polynomial in the word's bytes, so a block of text is hashed at once and no word is
    ever an object: every byte is weighted by its place in the block, and a word's sum is divided by
    the weight of its first byte.  Words of any length go through in blocks.
    """
    opens = np.zeros(len(raw) + 1, dtype=bool)
    opens[offsets[:-1]] = True
    starts, sums, open_at = [], [], -1
    for lo in range(0, len(raw), _STEP):
        part = raw[lo : lo + _STEP]
        solid = _solid(part)
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        begin |= solid & opens[lo : lo + len(part)]
        if lo and solid[0] and not opens[lo]:
            begin[0] = not _solid(raw[lo - 1 : lo])[0]
        first = np.flatnonzero(begin)
        value = _VALUE[part] * _POWERS[: len(part)]
        cuts = first if len(first) and first[0] == 0 else np.r_[0, first]
        total = np.add.reduceat(value, cuts)
        if len(cuts) > len(first):
            if sums:  # the word that a block before left open; its value is zero where that had ended
                sums[-1][-1:] += total[:1] * np.uint64(pow(_BASE, lo - open_at, 1 << 64))
            total = total[1:]
        if len(first):
            starts.append(first + lo)
            sums.append(total * _INVERSES[first])
            open_at = int(first[-1]) + lo
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), mix(np.concatenate(sums))


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, row bounds) of a string column."""
    raw, offsets = raw_text(column)
    starts, hashes = words(raw, offsets)
    return hashes, np.searchsorted(starts, offsets)


def distinct_sorted(group: np.ndarray, member: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Members without repeats in each group, by group, rank (below 1024) and hash."""
    rank = np.zeros(len(member), np.uint64) if rank is None else rank.astype(np.uint64)
    if not len(member):
        return group, member, rank
    if int(group[-1]) < 1 << 22:
        key = (group.astype(np.uint64) << np.uint64(42)) | (rank << np.uint64(32)) | (member >> np.uint64(32))
        order = np.argsort(key)
        key = key[order]
        tie = key[1:] == key[:-1]
        if (tie & (member[order][1:] != member[order][:-1])).any():
            order = np.lexsort((member, rank, group))
    else:
        order = np.lexsort((member, rank, group))
    group, member, rank = group[order], member[order], rank[order]
    fresh = np.r_[True, (member[1:] != member[:-1]) | (group[1:] != group[:-1])]
    return group[fresh], member[fresh], rank[fresh]


def describe(member: np.ndarray, ends: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, parity of shape sets x width) of sets that lie one after another."""
    mixed = mix(member)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    bit, column = np.uint64(1) << (mixed & np.uint64(63)), (mixed >> np.uint64(6)) & np.uint64(width - 1)
    parity = np.zeros((len(ends), width), dtype=np.uint64)
    for k in range(width):
        flips = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.where(column == k, bit, np.uint64(0)))])
        parity[:, k] = flips[ends] ^ flips[ends - n]
    return mix(sums[ends] - sums[ends - n]), parity


def as_binary(parity: np.ndarray) -> pa.Array:
    """Rows of longs as binary values."""
    size = parity.shape[1] * 8
    return pa.BinaryArray.from_buffers(pa.binary(), len(parity), [None, pa.py_buffer(np.arange(len(parity) + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(parity))])


def overlap_needed(a, b, threshold: float):
    """Common members that sets of ``a`` and ``b`` need for the threshold."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9).astype(np.int64)


def prefix_length(n, threshold: float):
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def member_counts(rows: DataFrame, members: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """Occurrences of members by hash bucket over all of (text): a fixed 2**SKETCH_BITS numbers."""
    slices, size = 16, 1 << SKETCH_BITS

    @common.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for lo, hi in common.pieces(batch, "text"):
                sums += np.bincount((members(batch.column("text").slice(lo, hi - lo)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        for k, part in enumerate(np.split(sums, slices)):
            if part.any():
                small = part.astype(np.uint32) if part.max() < 1 << 32 else part
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([small.tobytes()], pa.binary())], names=["slice", "counts"])

    def unpack(blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, np.uint32 if len(blob) == 4 * size // slices else np.int64).astype(np.int64)

    @common.tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                held[k] = held[k] + unpack(blob) if k in held else unpack(blob)
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    table = rows.select("text").mapInArrow(count, schema).repartition(slices, "slice").mapInArrow(add, schema).toArrow()
    out = np.zeros(size, dtype=np.int64)
    for k, blob in zip(table.column("slice").to_pylist(), table.column("counts").to_pylist(), strict=True):
        out[k * (size // slices) : (k + 1) * (size // slices)] = np.frombuffer(blob, np.int64)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of 10 bits: what orders members, ties being broken by hash."""
    return np.minimum(np.log2(np.maximum(counts, 1)) * 16, 1023).astype(np.uint16)


def rank_of(member: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return scale[(member >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]


def prefixes(member: np.ndarray, rank: np.ndarray, starts: np.ndarray, n: np.ndarray, threshold: float, frequent: int) -> tuple[pa.Array, np.ndarray]:
    """(prefix as a list of 32-bit hashes, how many of it are not frequent) of sets in order of rarity."""
    length = np.minimum(prefix_length(n, threshold) + 1, n)
    at = common.gather_ranges(starts, length)
    owner = np.repeat(np.arange(len(n)), length)
    rare = np.bincount(owner[rank[at] <= frequent], minlength=len(n))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(member[at].astype(np.uint32).view(np.int32))), rare


def _bands(n: np.ndarray, threshold: float) -> np.ndarray:
    """Size bands such that sets that can reach the threshold lie in one or in neighbouring bands."""
    return np.floor(np.log(n) / (np.log(1 / threshold) * (1 + 1e-9))).astype(np.int64)


def _keys(prefix: np.ndarray, starts: np.ndarray, n: np.ndarray, rare: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, position, owner): each prefix member that isn't frequent, and for each frequent one keys that narrow its list.

    Sets of at most SHORT members enter a frequent member with each later one: two sets that match and whose first common
    member is frequent share two members of prefixes one member longer, and all later members are frequent too.  Longer
    sets enter it with their size band and the next one, which grows in line with the prefix and not with its square;
    so do those short ones that a longer one can match.
    """
    length = prefix_length(n, threshold)
    single = np.minimum(rare, length)
    at = common.gather_ranges(starts, single)
    owner = np.repeat(np.arange(len(n)), single)
    key, position = prefix[at].astype(np.uint64), at - starts[owner]
    paired = np.where(n <= SHORT, length - single, 0)
    own = np.repeat(np.arange(len(n)), paired)
    first = common.gather_ranges(starts + single, paired)
    rest = np.minimum(length[own] + 1, n[own]) - (first - starts[own]) - 1
    second = common.gather_ranges(first + 1, rest)
    one = np.repeat(np.arange(len(first)), rest)
    pair = mix((prefix[first[one]].astype(np.uint64) << np.uint64(32)) | prefix[second].astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    banded = np.where(n >= np.floor(threshold * SHORT), length - single, 0)
    long = np.repeat(np.arange(len(n)), banded)
    where = common.gather_ranges(starts + single, banded)
    band = _bands(np.maximum(n, 1), threshold)[long]
    sized = [mix((prefix[where].astype(np.uint64) << np.uint64(32)) ^ mix((band + k).astype(np.uint64))) & np.uint64(0xFFFFFFFF) for k in (0, 1)]
    keys = np.concatenate([key, pair, *sized]).astype(np.uint32)
    place = where - starts[long]
    return keys, np.r_[position, first[one] - starts[own[one]], place, place], np.r_[owner, own[one], long, long]


def _packed(bucket: np.ndarray, *columns: np.ndarray, tail: bytes = b"") -> pa.RecordBatch:
    """Rows of columns, sorted by bucket, as one (bucket, binary) row per bucket; each ends in ``tail``."""
    cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
    blobs = [b"".join(np.ascontiguousarray(c[a:b]).tobytes() for c in columns) + tail for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.record_batch([pa.array(bucket[cuts[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "packed"])


def _unpacked(blobs: list[bytes], types: list[tuple]) -> list[np.ndarray]:
    """The columns of packed rows; types are (dtype, width)."""
    row = sum(np.dtype(t).itemsize * w for t, w in types)
    parts: list[list[np.ndarray]] = [[] for _ in types]
    for blob in blobs:
        rows, at = len(blob) // row, 0
        for (t, w), part in zip(types, parts, strict=True):
            part.append(np.frombuffer(blob, t, rows * w, at).reshape((rows, w) if w > 1 else rows))
            at += rows * w * np.dtype(t).itemsize
    return [np.concatenate(p) for p in parts]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The packed rows of one bucket after another, of a partition sorted by bucket."""
    held, now = [], None
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append(blob)
    if held:
        yield held


def _dealt(packed: DataFrame, tasks: int) -> DataFrame:
    return packed.repartition(tasks, "bucket").sortWithinPartitions("bucket")


def connect(key: np.ndarray, n: np.ndarray, position: np.ndarray, node: np.ndarray, parity: np.ndarray, forest: simhash.Forest, threshold: float, longest: int = LONGEST) -> None:
    """Link in ``forest`` whatever meets under a key and passes the filters; rows are sorted by key and n, and the bitmaps of sets of ``longest`` members or more don't count."""
    ends = np.r_[np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
    sizes = np.diff(np.r_[0, ends])
    last = np.repeat(ends, sizes)

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        need = overlap_needed(n[i], n[j], threshold)
        out = np.minimum(n[i] - position[i], n[j] - position[j]) >= need
        i, j, need = i[out], j[out], need[out]
        bits = np.bitwise_count(parity[i] ^ parity[j])
        differ = bits.astype(np.int64) if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int64)
        out[out] = (differ <= n[i] + n[j] - 2 * need) | (n[j] >= longest)
        return out

    def finish(live: np.ndarray) -> np.ndarray:
        """Take runs out of ``live`` in which few sets are outside of one tree, after comparing those with all."""
        first = np.unique(last[live] - np.repeat(sizes, sizes)[live])
        size = last[first] - first
        run = np.repeat(np.arange(len(first)), size)
        at = common.gather_ranges(first, size)
        root = forest.roots(node[at])
        order = np.lexsort((root, run))
        edge = np.flatnonzero(np.r_[True, (run[order][1:] != run[order][:-1]) | (root[order][1:] != root[order][:-1])])
        held, of = np.diff(np.r_[edge, len(order)]), run[order][edge]
        best = np.lexsort((held, of))
        main = root[order][edge][best[np.flatnonzero(np.r_[of[best][1:] != of[best][:-1], True])]]
        out = root != main[run]
        few = np.bincount(run[out], minlength=len(first)) * 8 <= size
        odd, own = at[out & few[run]], run[out & few[run]]
        for lo in range(0, len(odd), max(1, (1 << 21) // int(size.max(initial=1)))):
            part = slice(lo, lo + max(1, (1 << 21) // int(size.max(initial=1))))
            j = common.gather_ranges(first[own[part]], size[own[part]])
            i = np.repeat(odd[part], size[own[part]])
            i, j = np.minimum(i, j), np.maximum(i, j)
            ok = (i != j) & (n[i] >= np.ceil(threshold * n[j] - 1e-9))
            i, j = i[ok], j[ok]
            ok = near(i, j)
            forest.link(node[i[ok]], node[j[ok]])
        done = np.zeros(len(key) + 1, dtype=bool)
        done[last[first[few]]] = True
        return live[~done[last[live]]]

    live, step = np.flatnonzero(last - np.arange(len(key)) > 1), 1
    while len(live):
        other = live + step
        ok = n[live] >= np.ceil(threshold * n[other] - 1e-9)
        live, other = live[ok], other[ok]  # sorted by size: what is too large now stays so
        ok = near(live, other)
        if ok.any():
            forest.link(node[live[ok]], node[other[ok]])
        step += 1
        live = live[live + step < last[live]]
        if step in LOOKS and len(live):
            live = finish(live)


def linked(table: DataFrame, threshold: float, width: int) -> DataFrame:
    """(node, root): signatures in one component with the smallest of it, over links that pass the filters.

    ``table`` has signature, n, rare, parity (a long, or binary of ``width`` of them) and prefix; rows without prefix take no part.
    """
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (2 * tasks - 1).bit_length())
    types = [(np.uint32, 1), (np.uint32, 1), (np.int64, 1), (np.uint64, width)]

    @common.tidy
    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            key, place, signature, parity = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(key)
            key = key[order]
            return _packed((key >> np.uint32(32 - bits)).astype(np.int32), key, place[order], signature[order], parity[order])

        for batch in common.gathered(batches):
            n, rare, signature = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "rare", "signature"))
            lists = batch.column("prefix")
            bounds = lists.offsets.to_numpy().astype(np.int64)
            prefix = lists.values.to_numpy().view(np.uint32)
            parity = batch.column("parity")
            parity = np.frombuffer(b"".join(parity.to_pylist()), np.uint64) if pa.types.is_binary(parity.type) else parity.to_numpy().view(np.uint64)
            parity = parity.reshape((len(n), width)) if width > 1 else parity
            key, position, owner = _keys(prefix, bounds[:-1], n, rare, threshold)
            long = n[owner] >= LONGEST
            place = (np.minimum(n[owner], LONGEST) << 16 | np.where(long, 0, position)).astype(np.uint32)
            held.append((key, place, signature[owner], parity[owner]))
            size += len(key)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    @common.tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _by_bucket(batches):
            key, place, signature, parity = _unpacked(blobs, types)
            order = np.lexsort((signature, place, key))
            key, place, signature = key[order], place[order], signature[order]
            fresh = np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (signature[1:] != signature[:-1])]
            key, place, signature, parity = key[fresh], place[fresh].astype(np.int64), signature[fresh], parity[order[fresh]]
            crowd = np.r_[False, key[1:] == key[:-1]]
            crowd[:-1] |= crowd[1:]  # keys of one set meet nothing
            key, place, signature, parity = key[crowd], place[crowd], signature[crowd], parity[crowd]
            if not len(key):
                continue
            known, node = np.unique(signature, return_inverse=True)
            forest = simhash.Forest(len(known))
            connect(key, place >> 16, place & 0xFFFF, node, parity, forest, threshold)
            root = forest.roots(np.arange(len(known)))
            moved = np.flatnonzero(root != np.arange(len(known)))
            if len(moved):
                yield stars(known[moved], known[root[moved]], bits)

    packed = "bucket int, packed binary"
    entered = table.where("prefix is not null").select("signature", "n", "rare", "parity", "prefix").mapInArrow(enter, packed)
    met = _dealt(entered, tasks).mapInArrow(meet, packed)
    return settled(met, tasks)


def stars(node: np.ndarray, root: np.ndarray, bits: int) -> pa.RecordBatch:
    """Links to roots, packed by a bucket of 2**bits of their node."""
    bucket = (mix(node.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(bucket)
    return _packed(bucket[order], node[order], root[order])


def settled(met: DataFrame, tasks: int) -> DataFrame:
    """(node, root) of the components of packed ``stars``."""

    @common.tidy
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One smallest root per node, and links from its other roots to that."""
        for blobs in _by_bucket(batches):
            node, root = _unpacked(blobs, [(np.int64, 1), (np.int64, 1)])
            order = np.lexsort((root, node))
            node, root = node[order], root[order]
            first = np.r_[True, node[1:] != node[:-1]]
            least = root[first][np.cumsum(first) - 1]
            rows = np.unique(np.concatenate([np.stack([node[first], root[first]], 1), np.stack([root, least], 1)[root != least]]), axis=0)
            yield pa.record_batch([pa.array(np.ascontiguousarray(rows[:, k])) for k in (0, 1)], names=["a", "b"])

    return simhash.components(_dealt(met, tasks).mapInArrow(settle, "a long, b long"))


def members(links: DataFrame, label: str) -> DataFrame:
    """(s, root): every signature that ``linked`` has put into a component, roots included; written."""
    found = links.select(F.col("node").alias("s"), "root")
    return common.materialise(found.unionAll(found.select(F.col("root").alias("s"), "root").distinct()), label)


def in_blocks(rows: DataFrame, name: str, blocks) -> DataFrame:
    """Rows of a component ``root`` dealt by their column ``name``: once per block pair (i, j) that holds their ``block``."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(name), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    return dealt.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).drop("with")


def grouped(batches: Iterator[pa.RecordBatch], size: int, text: str) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups (root, i, j) of a sorted partition, of about ``size`` bytes of text, one group at least."""
    held, held_bytes = [], 0
    for batch in batches:
        for lo, hi in common.pieces(batch, text, size):
            held.append(batch.slice(lo, hi - lo))
            held_bytes += held[-1].column(text).nbytes
            if held_bytes < size:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = np.stack([whole.column(c).to_numpy() for c in ("root", "i", "j")], 1)
            cut = int(np.flatnonzero((keys != keys[-1]).any(axis=1)).max(initial=-1)) + 1
            if cut:
                yield whole.slice(0, cut)
            held, held_bytes = [whole.slice(cut)], whole.slice(cut).column(text).nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
