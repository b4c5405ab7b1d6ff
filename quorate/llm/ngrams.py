"""Hashed byte n-grams of whole text columns, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import common

WIDTH = 3


def byte_map(letters_only: bool) -> np.ndarray:
    """Byte translation: A-Z to a-z, digits to 0, white space to space; else kept, or to space if ``letters_only``."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    table[ord("0") : ord("9") + 1] = ord("0")
    table[:33] = 32
    if letters_only:
        for b in range(128):
            if not chr(table[b]).isalpha():
                table[b] = 32
    return table


def coded(column: pa.Array, table: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bucket of each n-gram, bounds of the rows' n-grams) for runs of rows.

    A text is one space, its bytes, one space; Latin-1 capitals in UTF-8 become small.  Runs hold
    about a megabyte of text; a longer single text is one run.
    """
    batch = pa.record_batch([column], names=["t"])
    for lo, hi in common.pieces(batch, "t", 1 << 20):
        texts = common.text_bytes(column.slice(lo, hi - lo)).to_pylist()
        raw = np.frombuffer(b" " + b"  ".join(texts) + b" ", dtype=np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts)))
        data = table[raw]
        capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
        data[1:][capital] += 32
        wide = data.astype(np.uint32)
        codes = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        dull = (data[:-2] == 32) & (data[1:-1] == 32)  # runs of space say nothing
        codes = ((codes * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64)
        # the last two positions of a text would reach into the next one
        inside = np.ones(len(codes), dtype=bool)
        for k in (2, 1):
            cut = ends[:-1] - k
            inside[cut[cut < len(codes)]] = False
        keep = inside & ~dull
        counts = np.r_[0, np.cumsum(keep)]
        bounds = counts[np.minimum(np.r_[0, ends], len(codes))]
        yield lo, codes[keep], bounds


def distinct_in_rows(codes: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's codes without repeats, and the new bounds."""
    last, keep, ticks = np.zeros(1 << bits, dtype=np.int64), np.empty(len(codes), dtype=bool), np.arange(len(codes))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = codes[a:b]
        last[own] = ticks[a:b]
        keep[a:b] = last[own] == ticks[a:b]
    return codes[keep], np.r_[0, np.cumsum(keep)][bounds]


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    return sums[bounds[1:]] - sums[bounds[:-1]]
