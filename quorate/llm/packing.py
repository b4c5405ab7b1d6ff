"""Packing token sequences by concatenating and cutting, with two-pass prefix sums.

Pass 1 tokenises every document once and writes, without any shuffle, the document's ids, the
number of its partition and the running token count inside that partition.  The totals of the
partitions (one small row each) give their global offsets by a prefix sum.  Pass 2 adds the two
and cuts the stream into fixed windows; a document that crosses window borders yields a boundary
record for each window it touches.

All windows are full but the end of the stream: its rest is cut into powers of two in falling
order, which need no padding, so nothing is padded at all.

Defined results: a null text is empty and still has its end token; null and repeated ids are
carried as they are (each row is a document); an empty table gives an empty result; other columns
of the input are ignored.  Documents follow one another in the order of the scan; the written
table of pass 1 fixes it, so that a lost executor can't change offsets between the passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

END_ID = 2
WINDOW = 4096
#: Words, and bytes of them, whose ids a Python worker keeps; beyond it the memory is emptied and refilled.
CACHE_WORDS = 400_000
CACHE_BYTES = 32 << 20
#: Bytes of text that are encoded at a time.
PIECE = 8 << 20


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of a tokenizer that never joins characters across white space, word by word.

    The tokenizer file must drop white space before it cuts words (word-end BPE), so the ids of a
    text are those of its white-space separated words in a row.  Each distinct word is encoded by
    the tokenizer and kept; a full memory is emptied.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}
        self.held = 0
        self.pool, self.starts, self.lengths = (common.Growing(t) for t in (self.dtype, np.int64, np.int64))
        self.starts.extend(np.zeros(1, np.int64))
        self.lengths.extend(np.zeros(1, np.int64))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in a row, number of ids of each row) of a string column."""
        import pyarrow.compute as pc

        if column.null_count:
            column = column.fill_null("")
        # a special token is written in one case only, so texts that may hold one keep theirs
        special = pc.any(pc.match_substring(column, "<|")).as_py()
        codes, words, bounds = common.split_words(column, lower=not special)
        pool, starts, lengths = self._local(words)
        per_word = lengths[codes]
        before = np.r_[0, np.cumsum(per_word)]
        return pool[common.gather_ranges(starts[codes], per_word)], before[bounds[1:]] - before[bounds[:-1]]

    def _local(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of these distinct words: a pool with each word's start and length."""
        if len(self.known) > CACHE_WORDS or self.held > CACHE_BYTES:
            self._clear()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        if len(fresh := np.flatnonzero(at < 0)):
            first = len(self.known)
            self._learn([words[i] for i in fresh])
            at[fresh] = np.arange(first, first + len(fresh))
        return self.pool.data, self.starts.data[at], self.lengths.data[at]

    def _learn(self, words: list[bytes]) -> None:
        ids: list = [None] * len(words)
        model, others = self.model.tokenize, []
        for i, w in enumerate(words):
            if m := _PLAIN.fullmatch(w):
                # one run of lower-case letters is one word to the model, written in its byte alphabet
                head, tail = m.groups()
                ids[i] = [t.id for t in model(head.decode("latin-1").translate(_ALPHABET))]
                if tail:
                    ids[i] += [t.id for t in model(tail.decode())]
            else:
                others.append(i)
        for i, e in zip(others, self.tokenizer.encode_batch_fast([words[i].decode("utf-8", "replace") for i in others], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        first = len(self.known)
        self.held += sum(map(len, words))
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.starts.extend(self.pool.size + np.cumsum(lengths) - lengths)
        self.lengths.extend(lengths)
        self.pool.extend(np.fromiter(chain.from_iterable(ids), dtype=self.dtype, count=int(lengths.sum())))


#: Lower-case letters of ASCII and Latin-1 in UTF-8, unchanged by composition and lower-casing, then
#: perhaps one mark, which is a word of its own to the tokenizer.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([.,;:!?]?)")


def _byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


_ALPHABET = _byte_alphabet()
_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenised(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids binary, tokens, part, part_start): pass 1.  ids are unsigned integers, as wide
    as the vocabulary needs, the end id included."""

    @common.tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, total = _encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi in common.pieces(batch, "text", PIECE):
                ids, counts = encoder.encode(batch.column("text").slice(lo, hi - lo))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                ends = np.cumsum(counts)
                offsets = np.r_[0, ends * ids.dtype.itemsize].astype(np.int32)
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                columns = [batch.column("doc_id").slice(lo, hi - lo), binary, pa.array(counts), pa.array(np.full(len(counts), part, dtype=np.int32)), pa.array(total + ends - counts)]
                total += int(ends[-1])
                yield pa.record_batch(columns, names=["doc_id", "ids", "tokens", "part", "part_start"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(encode, "doc_id long, ids binary, tokens long, part int, part_start long")


def cut_points(start: int, length: int, total: int, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Records (start in document, length, sequence, offset) of the tokens [start, start+length) of the stream.

    The stream has ``total`` tokens: full windows, then the rest in falling powers of two.
    """
    full = total // window
    out, at, end = [], start, start + length
    while at < end:
        if at < full * window:
            seq, offset = divmod(at, window)
            size = window
        else:
            rest, seq, base = total - full * window, full, full * window
            size = 1 << (rest.bit_length() - 1)
            while at >= base + size:
                base, rest, seq = base + size, rest - size, seq + 1
                size = 1 << (rest.bit_length() - 1)
            offset = at - base
        n = min(end - at, size - offset)
        out.append((at - start, n, seq, offset))
        at += n
    return out


def pack(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (uint32 binary), doc_tokens, sequence_id, offset."""
    rows = common.materialise(tokenised(docs, vocabulary or vocabulary_path(), id_col, text_col, end_id), "tokens")
    totals = rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("tokens")).alias("n"))
    # one row per partition: the prefix sum over them is metadata of the job, not of the documents
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    offsets = common.materialise(offsets, "offsets")  # its size is then known, and the join's side chosen by it
    placed = rows.join(offsets, "part").select("doc_id", "ids", "tokens", (F.col("base") + F.col("part_start")).alias("at"), "total")

    @common.tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            out: list[tuple] = []
            for doc, ids, n, at, total in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "tokens", "at", "total")), strict=True):
                wide = np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()
                out += [(doc, s, k, wide[4 * s : 4 * (s + k)], n, q, o) for s, k, q, o in cut_points(at, n, total, window)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names=names)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack_digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs, vocabulary).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5(spark, sf_dir: str) -> DataFrame:
    return pack_digest(common.read_table(spark, sf_dir, "documents"))


