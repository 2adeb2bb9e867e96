"""Monotone sequences of whole numbers in Elias-Fano form, read in place from a buffer, many places at a time.

Of n numbers up to u the low log2(u / n) bits stand side by side, and the high parts as a row of bits: each number a one, each step of the
high part a zero. About 2 + log2(u / n) bits a number; the i-th number is a select of the i-th one, the successor of a value a select of the zeros
around its high part and a binary search of the few low parts between.
"""

from __future__ import annotations

import numpy as np

from .hashing import U64

_WORD = np.uint64(63)
#: places asked for are many where they are over this part of the sequence
MANY = 16


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) of each word."""
    out = np.zeros(len(words), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count(words & U64((1 << step) - 1)).astype(np.int64)
        on = k >= count
        k = np.where(on, k - count, k)
        words = np.where(on, words >> U64(step), words)
        out += on * step
    return out


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits side by side in 64-bit words, and a word more."""
    out = np.zeros(len(values) * width // 64 + 2, U64)
    if width and len(values):
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(U64)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = np.flatnonzero((at & 63) + width > 64)  # one at most in each word
        out[word[over] + 1] |= values[over] >> (U64(64) - shift[over])
    return out


class Monotone:
    """A sequence in a buffer; its arrays are views of the buffer."""

    def __init__(self, raw: memoryview | bytes, at: int = 0) -> None:
        self.n, self.width, low, high = np.frombuffer(raw, np.int64, 4, at).tolist()
        self.low = np.frombuffer(raw, U64, low, at + 32)
        self.high = np.frombuffer(raw, U64, high, at + 32 + 8 * low)
        self.end = at + 32 + 8 * (low + high)
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones, self.zeros = np.cumsum(ones), np.cumsum(64 - ones)

    @staticmethod
    def dump(values: np.ndarray) -> bytes:
        """The buffer of ascending numbers from 0 on (repeats allowed)."""
        v, n = values.astype(U64), len(values)
        width = max(0, int((int(v[-1]) // n) if n else 0).bit_length() - 1)
        top = (v >> U64(width)).astype(np.int64)
        bits = np.zeros(-(-(n + (int(top[-1]) if n else 0) + 2) // 64) * 64, np.uint8)
        bits[top + np.arange(n)] = 1
        high, low = np.packbits(bits, bitorder="little").view(U64), _packed(v & U64((1 << width) - 1), width)
        return np.array([n, width, len(low), len(high)], np.int64).tobytes() + low.tobytes() + high.tobytes()

    def _place(self, counts: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(counts, k, side="right")
        before = np.where(word > 0, counts[np.maximum(word - 1, 0)], 0)
        return word * 64 + _select(~self.high[word] if flip else self.high[word], k - before)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(U64)
        over = np.where(shift > 0, self.low[word + 1] << ((U64(64) - shift) & _WORD), U64(0))
        return (self.low[word] >> shift | over) & U64((1 << self.width) - 1)

    def all(self) -> np.ndarray:
        """All numbers, one after the other."""
        top = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little")) - np.arange(self.n)
        return (top.astype(U64) << U64(self.width) | self._low(np.arange(self.n))).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i; where they are many beside n, by reading the sequence once."""
        if len(i) * MANY > self.n:
            return self.all()[i]
        return ((self._place(self.ones, i, False) - i).astype(U64) << U64(self.width) | self._low(i)).astype(np.int64)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """The first place whose number is not under each value; n where there is none. Many values meet the sequence read once."""
        if len(values) * MANY > self.n:
            return np.searchsorted(self.all(), values)
        out = np.full(len(values), self.n, np.int64)
        if not self.n:
            return out
        top = values >> self.width
        inside = top <= int(self.zeros[-1]) - 1  # the row of bits ends in zeros after the last one
        top, low = top[inside], (values[inside] & ((1 << self.width) - 1)).astype(U64)
        lo = np.where(top > 0, self._place(self.zeros, np.maximum(top - 1, 0), True) - (top - 1), 0)
        hi = self._place(self.zeros, top, True) - top
        lo, hi = np.minimum(lo, self.n), np.minimum(hi, self.n)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            under = self._low(mid) < low[live]
            lo[live] = np.where(under, mid + 1, lo[live])
            hi[live] = np.where(under, hi[live], mid)
            live = live[lo[live] < hi[live]]
        out[inside] = lo
        return out
