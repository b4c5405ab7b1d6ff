"""What every two keys have in common, counted over the rows where they meet, without a row for each meeting.

A join of the long form with itself makes one row of every meeting of two keys, and shuffles them all.  Here keys are
dealt in their order into blocks of neighbours by their number of meetings; keys that aren't whole numbers are numbered first.
The list of a meeting place (an item's voters, a voter's items) is sent once to each block that has a key in it, from that key on, as
steps of a byte; the block's task meets its keys with the rest of each list, a chunk at a time, and only pairs that meet often
enough leave it.  So no more than the lists are shuffled, and a task holds its block's lists and one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import written
from .ranks import running

#: Meetings of a block, counted from both sides; a key that has more is a block of its own.
BLOCK = 16_000_000
#: Blocks from which they grow with the meetings, up to fourfold: fewer blocks get fewer copies of the lists.
BLOCKS = 128
#: Elements of lists that are packed at a time.
PACK = 1_000_000
#: Meetings that are sorted at a time; those of one key are never parted.
CHUNK = 2_000_000
#: Sums over a pair's meetings: of either value, of their squares and of their product.
SUMS = ("sa", "sb", "saa", "sbb", "sab")


def _numbered(cells: DataFrame) -> DataFrame:
    """(key, code, before) of the keys of (place, key): codes in the order of keys, and the meetings of the keys before."""
    sizes = cells.groupBy("place").agg(F.count("*").alias("__met"))
    load = cells.join(sizes, "place").groupBy("key").agg(F.sum("__met").alias("__load"), F.lit(1).alias("__one"))
    return running(load, [], ["key"], ["__load", "__one"]).select("key", F.col("before___one").cast("int").alias("code"), F.col("before___load").alias("before"))


def _chunks(codes: np.ndarray, meetings: np.ndarray) -> list[slice]:
    """Slices of the sorted ``codes`` that hold whole codes and about ``CHUNK`` meetings."""
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    load = np.add.reduceat(meetings, first)
    cuts = first[np.r_[True, np.diff(np.cumsum(load) // CHUNK) > 0]]
    return [slice(a, b) for a, b in zip(cuts, np.r_[cuts[1:], len(codes)], strict=True)]


def _binary(key: np.ndarray, x: np.ndarray, y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, dict]:
    packed = np.sort(key << 2 | x.astype(np.int64) << 1 | y.astype(np.int64))
    key = packed >> 2
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.diff(np.r_[start, len(key)])
    x, y = packed >> 1 & 1, packed & 1
    often = n >= least
    sums = {"sa": x, "sb": y, "saa": x, "sbb": y, "sab": x & y}
    return key[start[often]], n[often], {name: np.add.reduceat(v, start)[often] for name, v in sums.items()}


def _real(key: np.ndarray, x: np.ndarray, y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, dict]:
    order = np.argsort(key, kind="stable")
    key, x, y = key[order], x[order], y[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.diff(np.r_[start, len(key)])
    often = n >= least
    sums = {"sa": x, "sb": y, "saa": x * x, "sbb": y * y, "sab": x * y}
    return key[start[often]], n[often], {name: np.add.reduceat(v, start)[often] for name, v in sums.items()}


def _packed(keys: np.ndarray, lens: np.ndarray, values: np.ndarray, low: int, binary: bool) -> bytes:
    """Sorted lists, one after another: each key as its step from the one before in bytes (255: and more), the first from ``low``; binary values as bits."""
    step = np.diff(keys, prepend=low)
    first = np.cumsum(lens) - lens
    step[first] = keys[first] - low
    wide = int(step.max(initial=0)) >= 16 * 255
    if not wide:
        end = np.cumsum(step // 255 + 1)
        rest, step = step % 255, np.full(int(end[-1]) if len(end) else 0, 255, np.uint8)
        step[end - 1] = rest
    tail = np.packbits(values.astype(np.uint8)) if binary else values.astype(np.float64)
    return b"".join(x.tobytes() for x in (np.array([len(lens), len(keys), len(step), wide], np.int64), lens.astype(np.int32), step, tail))


def _unpacked(blob: bytes, low: int, binary: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, lens, values) of ``_packed``."""
    lists, n, size, wide = np.frombuffer(blob, np.int64, 4).tolist()
    lens = np.frombuffer(blob, np.int32, lists, 32).astype(np.int64)
    at = 32 + 4 * lists
    step = np.frombuffer(blob, np.int64 if wide else np.uint8, size, at)
    total = np.cumsum(step, dtype=np.int64)
    if not wide:
        total = total[step != 255]
    keys = total - np.repeat(np.r_[np.int64(0), total][np.cumsum(lens) - lens], lens) + low
    at += step.nbytes
    return keys, lens, np.unpackbits(np.frombuffer(blob, np.uint8, -1, at), count=n) if binary else np.frombuffer(blob, np.float64, n, at)


def _sent(batches: Iterator[pa.RecordBatch], lows: np.ndarray, binary: bool) -> Iterator[pa.RecordBatch]:
    """(block, packed) of (keys, vals): every list in each block that has a key of it, from that key on."""
    for batch in batches:
        lists, values = batch.column("keys"), batch.column("vals")
        bounds, flat, value = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().astype(np.int64), values.values.to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(bounds[1:] // PACK)) + 1, len(bounds) - 1]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            edge = bounds[lo : hi + 1]
            block = np.searchsorted(lows, flat[edge[0] : edge[-1]], "right") - 1
            fresh = np.r_[True, block[1:] != block[:-1]][: len(block)]
            fresh[(edge[:-1] - edge[0])[np.diff(edge) > 0]] = True
            start = np.flatnonzero(fresh)
            block = block[start]
            start = start + edge[0]
            many = edge[np.searchsorted(edge, start, "right")] - start
            some = many > 1  # a last key alone meets nothing
            order = np.argsort(block[some], kind="stable")
            block, start, many = (x[some][order] for x in (block, start, many))
            opens = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(block)])
            blobs = []
            for a, b in zip(opens, np.r_[opens[1:], len(block)], strict=True):
                lens = many[a:b]
                at = np.repeat(start[a:b] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
                blobs.append(_packed(flat[at], lens, value[at], int(lows[block[a]]), binary))
            yield pa.record_batch([pa.array(block[opens], pa.int32()), pa.array(blobs, pa.binary())], names=["block", "packed"])


def _counted(batches: Iterator[pa.RecordBatch], lows: np.ndarray, least: int, sums: tuple[str, ...], binary: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pairs of one block from its packed lists, a chunk at a time."""
    parts, block = [], None
    for batch in batches:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            parts.append(_unpacked(blob, int(lows[block]), binary))
    if not parts:
        return
    known, lens, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    mine = np.arange(len(known)) if block + 1 == len(lows) else np.flatnonzero(known < lows[block + 1])
    known, flat = np.unique(known, return_inverse=True)
    bounds = np.r_[0, np.cumsum(lens)]
    mine = mine[np.argsort(flat[mine], kind="stable")]
    later = bounds[np.searchsorted(bounds, mine, "right")] - mine - 1
    span, count = np.int64(len(known)), _binary if binary else _real
    for part in _chunks(flat[mine], later):
        at, many = mine[part], later[part]
        total = int(many.sum())
        if not total:
            continue
        other = np.repeat(at + 1 - (np.cumsum(many) - many), many) + np.arange(total)
        at = np.repeat(at, many)
        one, two = flat[at], flat[other]
        apart = one < two  # a repeated key doesn't meet itself
        if not apart.all():
            at, other, one, two = at[apart], other[apart], one[apart], two[apart]
        if not len(at):
            continue
        key, n, found = count(one.astype(np.int64) * span + two, value[at], value[other], least)
        columns = [known[key // span], known[key % span], n, *(found[s] for s in sums)]
        yield pa.record_batch([pa.array(c).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def meetings(rows: DataFrame, place: str, key: str, value: Column, least: int = 1, sums: tuple[str, ...] = SUMS, binary: bool = True, size: int = BLOCK, save=written) -> DataFrame:
    """(a, b, n, sums) of keys a < b that meet ``least`` times or more: how often, and the sums of their values there.

    ``binary`` values are 0 or 1, with sums of type long; others are doubles.  Null places and keys meet nothing.
    """
    kind, whole = ("byte", "long") if binary else ("double", "double")
    cells = rows.select(F.col(place).alias("place"), F.col(key).alias("key"), value.cast(kind).alias("value")).where("place is not null and key is not null")
    codes = save(_numbered(cells))
    total = codes.agg(F.max("before").alias("last")).first()["last"] or 0
    size = max(size, min(4 * size, total // BLOCKS))
    numbers = dict(cells.dtypes)["key"] in ("bigint", "int", "smallint", "tinyint")
    name = "key" if numbers else "code"
    blocks = codes.groupBy(F.floor(F.col("before") / size).alias("block")).agg(F.min(name).alias("low"))
    lows = np.array(sorted(r["low"] for r in blocks.collect()) or [0], np.int64)  # one number a block
    cells = cells if numbers else cells.join(codes.select("key", "code"), "key").select("place", F.col("code").alias("key"), "value")
    lists = cells.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("list")).where(F.size("list") > 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent(batches, lows, binary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(batches, lows, least, sums, binary, schema)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), *((s, pa.int64() if binary else pa.float64()) for s in sums)])
    dealt = save(lists.select(F.col("list.key").cast("array<long>").alias("keys"), F.col("list.value").alias("vals"))).mapInArrow(send, "block int, packed binary")
    # no more than a few blocks share a task, however many there are: tasks grow in number with the blocks
    found = dealt.repartition(2 * len(lows), "block").groupBy("block").applyInArrow(count, f"a long, b long, n long{''.join(f', {s} {whole}' for s in sums)}")
    if numbers:
        return found.select(*(F.col(c).cast(dict(cells.dtypes)["key"]).alias(c) for c in ("a", "b")), "n", *sums)
    for end in ("a", "b"):
        found = found.withColumnRenamed(end, "code").join(codes.select("code", F.col("key").alias(end)), "code").drop("code")
    return found.select("a", "b", "n", *sums)
