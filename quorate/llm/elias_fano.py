"""Elias-Fano coded monotone sequences with vectorised access and successor search, on flat arrays.

A sequence of n values below u keeps the low bits of each value packed side by side and the high
bits in unary: about 2 + log2(u / n) bits a value.  All parts are plain arrays, so a sequence can
lie in a memory-mapped file and be read page by page.
"""

from __future__ import annotations

import json

import numpy as np

_ONE = np.uint64(1)


def _directory(words: np.ndarray) -> np.ndarray:
    """Ones before each word, and in total."""
    return np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)].astype(np.int64)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one of each word, by halving."""
    place, k = np.zeros(len(word), dtype=np.uint64), k.astype(np.int64).copy()
    for half in (32, 16, 8, 4, 2, 1):
        low = (word >> place) & np.uint64((1 << half) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        up = k >= ones
        k -= np.where(up, ones, 0)
        place += np.where(up, half, 0).astype(np.uint64)
    return place.astype(np.int64)


class Sequence:
    """Monotone (non-decreasing) non-negative values."""

    PARTS = ("head", "low", "high", "ones")

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.head, self.low, self.high, self.ones = head, low, high, ones
        self.n, self.bits = int(head[0]), int(head[1])

    @classmethod
    def build(cls, values: np.ndarray) -> Sequence:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(high[-1]) if n else 0) + 2
        flags = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
        flags[high] = 1
        words = np.packbits(flags, bitorder="little").view("<u8")
        low = np.zeros(-(-n * bits // 64) + 1, dtype=np.uint64)
        if bits:
            part, at = values & np.uint64((1 << bits) - 1), np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = (shift + np.uint64(bits)) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        return cls(np.array([n, bits], dtype=np.int64), low, words, _directory(words))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.int64) * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        first = self.low[word] >> shift
        back = np.where(shift > 0, np.uint64(64) - shift, np.uint64(63))
        second = np.where(shift > 0, self.low[np.minimum(word + 1, len(self.low) - 1)] << back, np.uint64(0))
        return (first | second) & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.bits)) | self._lows(i)

    def _before_zero(self, k: np.ndarray) -> np.ndarray:
        """Number of values whose high part is at most k."""
        zeros = np.arange(len(self.ones)) * 64 - self.ones  # zeros before each word
        total = int(zeros[-1])
        inside = k < total
        word = np.searchsorted(zeros, np.where(inside, k, 0), side="right") - 1
        place = word * 64 + _select_in_word(~self.high[np.minimum(word, len(self.high) - 1)], np.where(inside, k, 0) - zeros[word])
        return np.where(inside, np.minimum(place - k, self.n), self.n)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first value >= x, whether it equals x)."""
        x = np.asarray(x, dtype=np.uint64)
        if not self.n or not len(x):
            return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
        high, low = (x >> np.uint64(self.bits)).astype(np.int64), x & np.uint64((1 << self.bits) - 1)
        left = np.where(high > 0, self._before_zero(np.maximum(high - 1, 0)), 0)
        end = self._before_zero(high)
        right = end.copy()
        live = np.flatnonzero(left < right)
        while len(live):
            mid = (left[live] + right[live]) >> 1
            less = self._lows(mid) < low[live]
            left[live[less]] = mid[less] + 1
            right[live[~less]] = mid[~less]
            live = live[left[live] < right[live]]
        inside = left < end
        equal = np.zeros(len(x), dtype=bool)
        equal[inside] = self._lows(left[inside]) == low[inside]
        return left, equal


def write_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: a line that says where each array lies, then the arrays on 64-byte borders."""
    at, places = 0, {}
    for name, a in arrays.items():
        places[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(places).encode()
    head += b" " * (-(len(head) + 9) % 64)
    return b"%8d\n" % len(head) + head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 64) for a in arrays.values())


def read_arrays(data: np.ndarray) -> dict[str, np.ndarray]:
    size = int(bytes(data[:8]))
    body = data[9 + size :]
    return {name: body[at : at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, at) in json.loads(bytes(data[9 : 9 + size])).items()}
