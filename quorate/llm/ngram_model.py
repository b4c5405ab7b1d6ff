"""Language-model scoring with an Elias-Fano n-gram trie.

Training counts every token of the training texts (words between ASCII white space, A-Z
lower-cased, then one end per text) and all pairs of neighbouring tokens, those seen once too.
Probabilities interpolate pairs by absolute discounting with the smoothed unigrams and sum to one for every context.

The trie is cut into shards by word hash.  A shard holds its words as a monotone sequence of
hashes, their counts and back-off weights, monotone pointers into the next level, and there the
successors of each word, made monotone by adding up the ranges before (so a successor's value is
relative to its context), with quantised log probabilities.  A pair is found by a successor search
relative to its context.  Shards are files in shared storage which tasks map into memory, so the
model may be larger than any executor's memory and nothing but their names is broadcast.

Scale: counts are combined in every task and travel as packed blocks.  Pair counts are first merged
by (shard, slice of the second word), so that a context that holds a large share of all pairs is
split; one row per slice is gathered to build a shard.

Defined results: a null text is empty and has the end token only; null ids hash as empty text and
repeated rows each get a row and count each; without training rows all counts are 0; an empty
table gives an empty result; other columns are ignored.  Words are told apart by 63-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .elias_fano import Sequence, read_arrays, write_arrays

END = b"\n"  # no word holds white space
DISCOUNT = 0.75
LEAST = 1  # pairs seen less often are pruned: none, all that were seen count
SLICES = 8
PIECE = 4 << 20
#: Distinct pairs that a task merges before it hands them on.
HELD_PAIRS = 1_500_000
#: Log probabilities are kept as multiples of this step below zero.
STEP = 12.0 / 65535


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)) >> np.uint64(1)


def _quantise(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logs / STEP), 0, 65535).astype(np.uint16)


def pack_sorted(values: np.ndarray) -> bytes:
    """Non-decreasing integers as differences of seven bits a byte."""
    return _varint(np.diff(values, prepend=values.dtype.type(0)).astype(np.uint64))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unvarint(data), dtype=np.uint64)


def _varint(x: np.ndarray) -> bytes:
    size = np.ones(len(x), dtype=np.int64)
    for k in range(1, 10):
        size += x >= np.uint64(1 << (7 * k))
    ends = np.cumsum(size)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
    out = ((np.repeat(x, size) >> (7 * place).astype(np.uint64)) & np.uint64(127)).astype(np.uint8)
    out[place < np.repeat(size, size) - 1] |= 128
    return out.tobytes()


def _unvarint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts) if len(raw) else np.zeros(0, np.uint64)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return key, count
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(count, first)


def _tokens(column: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(code of each token, distinct tokens, bounds by row): the words of each text and its end."""
    codes, words, bounds = common.split_words(column)
    if b"" in words:
        real = codes != words.index(b"")
        bounds = np.r_[0, np.cumsum(real)][bounds]
        codes = codes[real]
    codes = np.insert(codes.astype(np.int64), bounds[1:], len(words))
    return codes, [*words, END], bounds + np.arange(len(bounds))


class Shard:
    """One shard of the trie, mapped from its file."""

    def __init__(self, uri: str):
        parts = read_arrays(common.map_bytes(uri))
        level = lambda name: Sequence(*(parts[f"{name}.{p}"] for p in Sequence.PARTS))
        self.words, self.counts = level("words"), parts["counts"]
        if "backoff" in parts:
            self.backoff, self.pointers, self.successors, self.logs = parts["backoff"], level("pointers"), level("successors"), parts["logs"]

    def find_words(self, hashes: np.ndarray) -> np.ndarray:
        at, same = self.words.successor(hashes)
        return np.where(same, at, -1)

    def find_pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Index of each (local first word, global second word) in the second level, or -1."""
        lo, hi = self.pointers.access(first).astype(np.int64), self.pointers.access(first + 1).astype(np.int64)
        out = np.full(len(first), -1)
        some = np.flatnonzero(lo < hi)
        if len(some):
            start = lo[some]
            base = np.zeros(len(some), dtype=np.uint64)
            base[start > 0] = self.successors.access(start[start > 0] - 1)
            at, same = self.successors.successor(base + second[some].astype(np.uint64) + np.uint64(1))
            ok = same & (at < hi[some])
            out[some[ok]] = at[ok]
        return out


@lru_cache(maxsize=4096)
def _shard(uri: str) -> Shard:
    return Shard(uri)


class Trie:
    """The shards by name, with the global numbers of their words."""

    def __init__(self, files: list[str], sizes: list[int]):
        self.files, self.firsts = files, np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.shift = np.uint64(63 - (len(files).bit_length() - 1))

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(global number or -1, count) of each word."""
        number, count = np.full(len(hashes), -1), np.zeros(len(hashes), dtype=np.int64)
        for s, own in self._by(hashes >> self.shift):
            shard = _shard(self.files[s])
            at = shard.find_words(hashes[own])
            ok = at >= 0
            number[own[ok]] = at[ok] + self.firsts[s]
            count[own[ok]] = shard.counts[at[ok]]
        return number, count

    def _by(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(len(self.files) + 1).astype(shard.dtype))
        for s in range(len(self.files)):
            if cuts[s] < cuts[s + 1]:
                yield s, order[cuts[s] : cuts[s + 1]]

    def of_number(self, number: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, number, side="right") - 1

    def pairs(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability of the pair or NaN, log10 back-off weight of the first) for global numbers."""
        log, back = np.full(len(first), np.nan), np.zeros(len(first))
        for s, own in self._by(self.of_number(first)):
            shard, local = _shard(self.files[s]), first[own] - self.firsts[s]
            at = shard.find_pairs(local, second[own])
            ok = at >= 0
            log[own[ok]] = shard.logs[at[ok]] * -STEP
            back[own] = shard.backoff[local] * -STEP
        return log, back


def _training(docs: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return docs.where(~common.held_out_column("doc_id", modulus, remainder)).select("text")


def count_words(train: DataFrame, shards: int) -> DataFrame:
    """(shard, hashes, counts): packed blocks of word counts, one a task and shard."""
    shift = np.uint64(63 - (shards.bit_length() - 1))

    @common.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def blocks():
            key, n = _merge(keys, counts)
            cuts = np.searchsorted(key >> shift, np.arange(shards + 1).astype(np.uint64))
            rows = [(s, pack_sorted(key[a:b]), _varint(n[a:b].astype(np.uint64))) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            return pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], schema=pa.schema([("shard", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])) if rows else None

        for batch in batches:
            for lo, hi in common.pieces(batch, "text", PIECE):
                codes, words, _ = _tokens(batch.column("text").slice(lo, hi - lo))
                n = np.bincount(codes, minlength=len(words))
                keys.append(_hashes(words)[n > 0])
                counts.append(n[n > 0])
                held += len(words)
                if held > 2_000_000:
                    key, n = _merge(keys, counts)
                    keys, counts, held = [key], [n], 0
                    if len(key) > 2_000_000 and (out := blocks()):
                        yield out
                        keys, counts = [], []
        if keys and (out := blocks()):
            yield out

    return train.mapInArrow(count, "shard int, hashes binary, counts binary")


def build_words(blocks: DataFrame, folder: str, shards: int) -> Trie:
    """Writes the first level and returns it; only names and sizes come to the driver."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        words, counts = _merge([unpack_sorted(x) for x in table.column("hashes").to_pylist()], [_unvarint(x) for x in table.column("counts").to_pylist()])
        sequence = Sequence.build(words)
        kind = np.uint32 if counts.max() < 1 << 32 else np.uint64
        uri = f"{folder}/words-{shard}"
        common.put_bytes(uri, write_arrays({f"words.{p}": getattr(sequence, p) for p in Sequence.PARTS} | {"counts": counts.astype(kind)}))
        return pa.table({"shard": pa.array([shard], pa.int32()), "uri": [uri], "size": [len(words)], "tokens": [int(counts.sum())]})

    rows = {r["shard"]: r for r in blocks.groupBy("shard").applyInArrow(lambda key, table: build(key, table), "shard int, uri string, size long, tokens long").collect()}
    for s in range(shards):
        if s not in rows:
            uri = f"{folder}/words-{s}"
            empty = Sequence.build(np.zeros(0, np.uint64))
            common.put_bytes(uri, write_arrays({f"words.{p}": getattr(empty, p) for p in Sequence.PARTS} | {"counts": np.zeros(0, np.uint32)}))
            rows[s] = {"uri": uri, "size": 0, "tokens": 0}
    trie = Trie([rows[s]["uri"] for s in range(shards)], [rows[s]["size"] for s in range(shards)])
    trie.vocabulary, trie.total = int(trie.firsts[-1]), sum(rows[s]["tokens"] for s in range(shards))
    return trie


def count_pairs(train: DataFrame, trie: Trie) -> DataFrame:
    """(shard, slice, pairs, counts): packed blocks of pair counts; pair = first << 32 | second."""
    shards = len(trie.files)
    if trie.vocabulary >= 0xFFFFFFFF:
        raise ValueError("word numbers must fit 32 bits; score with more than one model")

    def blocks(pairs: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pair, n = _merge(pairs, counts)
        cuts = np.searchsorted(pair, trie.firsts.astype(np.uint64) << np.uint64(32))
        rows = []
        for s in range(shards):
            own, times = pair[cuts[s] : cuts[s + 1]], n[cuts[s] : cuts[s + 1]].astype(np.uint64)
            side = own & np.uint64(SLICES - 1)
            rows += [(s, k, pack_sorted(own[side == k]), _varint(times[side == k])) for k in np.unique(side).tolist()]
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], schema=pa.schema([("shard", pa.int32()), ("slice", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary())]))

    @common.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, held = [], [], 0
        for batch in batches:
            for lo, hi in common.pieces(batch, "text", PIECE):
                codes, words, bounds = _tokens(batch.column("text").slice(lo, hi - lo))
                number, often = trie.words(_hashes(words))
                number[often < LEAST] = -1  # a rarer word has no pair that often
                tokens = number[codes]
                ok = (tokens[:-1] >= 0) & (tokens[1:] >= 0)
                ok[bounds[1:-1] - 1] = False
                pair, n = np.unique((tokens[:-1][ok].astype(np.uint64) << np.uint64(32)) | tokens[1:][ok].astype(np.uint64), return_counts=True)
                pairs.append(pair)
                counts.append(n)
                held += len(pair)
                if held > HELD_PAIRS:
                    yield from blocks(pairs, counts)
                    pairs, counts, held = [], [], 0
        if pairs:
            yield from blocks(pairs, counts)

    return train.mapInArrow(count, "shard int, slice int, pairs binary, counts binary")


def build_pairs(blocks: DataFrame, trie: Trie, folder: str) -> Trie:
    """Adds back-off weights, pointers and successors to each shard, in new files."""
    firsts, files, total, vocabulary = trie.firsts, trie.files, trie.total, trie.vocabulary

    def prune(key: tuple, table: pa.Table) -> pa.Table:
        pair, n = _merge([unpack_sorted(x) for x in table.column("pairs").to_pylist()], [_unvarint(x) for x in table.column("counts").to_pylist()])
        keep = n >= LEAST
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "pairs": [pack_sorted(pair[keep])], "counts": [_varint(n[keep])]})

    def build(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        pair, n = _merge([unpack_sorted(x) for x in table.column("pairs").to_pylist()], [_unvarint(x) for x in table.column("counts").to_pylist()])
        parts = read_arrays(common.map_bytes(files[s]))
        size, counts = int(firsts[s + 1] - firsts[s]), parts["counts"].astype(np.float64)
        first, second = (pair >> np.uint64(32)).astype(np.int64) - int(firsts[s]), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        share = (n - DISCOUNT) / counts[first]
        backoff = 1 - np.bincount(first, weights=share, minlength=size)
        # the unigram probability of each distinct second word, from its own shard
        known, inverse = np.unique(second, return_inverse=True)
        often, shard_of = np.zeros(len(known)), np.searchsorted(firsts, known, side="right") - 1
        for t in np.unique(shard_of):
            own = shard_of == t
            often[own] = read_arrays(common.map_bytes(files[t]))["counts"][known[own] - firsts[t]]
        one = (often + 0.5) / (total + 0.5 * (vocabulary + 1))
        logs = np.log10(share + backoff[first] * one[inverse])
        pointers = np.searchsorted(first, np.arange(size + 1))
        # successors: number + 1, plus the last value of the contexts before
        last = np.zeros(size + 1, dtype=np.uint64)
        ends = pointers[1:]
        some = ends > pointers[:-1]
        last[1:][some] = (second[ends[some] - 1] + 1).astype(np.uint64)
        base = np.cumsum(last, dtype=np.uint64)
        values = base[first] + (second + 1).astype(np.uint64)
        levels = {"words": None, "pointers": Sequence.build(pointers), "successors": Sequence.build(values)}
        arrays = {k: v for k, v in parts.items() if k.startswith("words.")} | {"counts": parts["counts"], "backoff": _quantise(np.log10(np.maximum(backoff, 1e-12))), "logs": _quantise(logs)}
        arrays |= {f"{name}.{p}": getattr(level, p) for name, level in levels.items() if level is not None for p in Sequence.PARTS}
        uri = f"{folder}/trie-{s}"
        common.put_bytes(uri, write_arrays({k: np.asarray(v) for k, v in arrays.items()}))
        return pa.table({"shard": pa.array([s], pa.int32()), "uri": [uri], "n": [len(pair)]})

    spark = blocks.sparkSession
    pruned = blocks.groupBy("shard", "slice").applyInArrow(lambda key, table: prune(key, table), "shard int, pairs binary, counts binary")
    # every shard gets its second level, if need be an empty one
    nothing = spark.range(len(files)).select(F.col("id").cast("int").alias("shard"), F.lit(b"").alias("pairs"), F.lit(b"").alias("counts"))
    rows = pruned.unionByName(nothing).groupBy("shard").applyInArrow(lambda key, table: build(key, table), "shard int, uri string, n long").collect()
    names = {r["shard"]: r["uri"] for r in rows}
    out = Trie([names[s] for s in range(len(files))], np.diff(firsts).tolist())
    out.vocabulary, out.total = vocabulary, total
    return out


def train_trie(train: DataFrame, shards: int | None = None) -> Trie:
    spark = train.sparkSession
    tasks = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = 1 << max(0, (tasks - 1).bit_length())
    folder = common.shared_path(spark, "trie")
    words = build_words(count_words(train, shards), folder, shards)
    return build_pairs(count_pairs(train, words), words, folder)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 1, shards: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    trie = train_trie(_training(rows, modulus, remainder), shards)
    floor = np.log10(trie.total + 0.5 * (trie.vocabulary + 1)) if trie.total else 0.0
    total = trie.total

    @common.tidy
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in common.pieces(batch, "text", PIECE):
                codes, words, bounds = _tokens(batch.column("text").slice(lo, hi - lo))
                number, often = trie.words(_hashes(words))
                base = (np.log10(often + 0.5) - floor)[codes]
                known = often[codes] > 0
                tokens, log = number[codes], base.copy()
                ok = np.r_[False, (tokens[:-1] >= 0)]
                ok[bounds[:-1]] = False
                at = np.flatnonzero(ok)
                first, second = tokens[at - 1], tokens[at]
                pair, inverse = np.unique((first.astype(np.uint64) << np.uint64(32)) | np.where(second >= 0, second, 0xFFFFFFFF).astype(np.uint64), return_inverse=True)
                found, back = trie.pairs((pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64))
                found, back = found[inverse], back[inverse]
                log[at] = np.where(np.isnan(found), base[at] + back, found)
                ids = batch.column("doc_id").slice(lo, hi - lo)
                n = len(bounds) - 1
                sums = [np.add.reduceat(x, bounds[:-1]) if n else x[:0] for x in (known.astype(np.int64), base, log)]
                yield pa.record_batch([ids, pa.array(common.held_out_flags(ids.to_pylist(), modulus, remainder), pa.bool_()), pa.array(np.diff(bounds)), pa.array(sums[0]), pa.array(np.full(n, total)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(apply, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7(spark, sf_dir: str) -> DataFrame:
    return score(common.read_table(spark, sf_dir, "documents"))
