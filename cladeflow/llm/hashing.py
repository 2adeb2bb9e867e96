"""64-bit hashes of pieces of a buffer, many pieces at a time, and exact comparison of pieces.

``piece_hashes`` are the same in every run: they deal, sample and number things whose equality is then told by their bytes. Whoever knows
their constants can make different pieces of one hash, so nothing counts as equal by them alone.

``keyed_hashes`` hang on a key that is drawn for each run. A piece is read as 32-bit numbers s_1 .. s_2m, and each half of the hash is the upper half of
sum of (k_2i-1 + s_2i-1) * (k_2i + s_2i) modulo 2^64, over multipliers k of its own (multilinear hashing in its half-multiplication form), with the
length as two more numbers: two pieces, however chosen before the key is drawn, share a hash with a probability of about 2^-64 (a few times that for those of over
LONG bytes, which are hashed as the sequence of their parts' hashes). Pieces of a sequence of 64-bit symbols are pieces of its bytes.
"""

from __future__ import annotations

import secrets
from functools import lru_cache

import numpy as np

U64 = np.uint64
LONG = 512
BLOCK = 1 << 15
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_ODD, _LENGTH = U64(0xD6E8FEB86659FD93), U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * _ODD
    x = x ^ (x >> U64(32))
    x = x * _ODD
    return x ^ (x >> U64(32))


def _step(h: np.ndarray, lane: np.ndarray) -> np.ndarray:
    x = h ^ lane
    x ^= x >> U64(32)
    x *= _ODD
    x ^= x >> U64(29)
    x *= _LENGTH
    return x


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on as a number, zeros standing after its end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, U64, padded, strides=(1,))


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the bytes start .. end - 1 of ``data``, for each pair of starts and ends."""
    size = ends - starts
    out = np.full(len(size), mix(np.array([seed + 1], U64))[0])
    long = size > LONG
    if long.any():
        first, parts = starts[long], -(-size[long] // LONG)
        at = np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(first, parts) + (np.arange(int(parts.sum())) - at) * LONG
        inner = piece_hashes(data, begin, np.minimum(begin + LONG, np.repeat(ends[long], parts)), seed)
        last = np.cumsum(parts)
        out[long] = piece_hashes(inner.view(np.uint8), 8 * (last - parts), 8 * last, seed + 1)
    view, short = lanes(data), np.flatnonzero(~long & (size > 0))
    for i in range(0, len(short), BLOCK):  # what the caches hold
        live = short[i : i + BLOCK]
        at, left, h = starts[live], size[live], out[live]
        while len(live):
            h = _step(h, view[at] & _MASKS[np.minimum(left, 8)])
            on = left > 8
            if on.all():
                at, left = at + 8, left - 8
                continue
            out[live] = h
            live, at, left, h = live[on], at[on] + 8, left[on] - 8, h[on]
    return mix(out + size.astype(U64) * _LENGTH)


def symbol_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the stretches start .. end - 1 of a sequence of 64-bit symbols."""
    return piece_hashes(np.ascontiguousarray(symbols).view(np.uint8), starts * 8, ends * 8, seed)


def draw() -> int:
    """A key for one run."""
    return secrets.randbits(62)


@lru_cache(8)
def multipliers(key: int) -> np.ndarray:
    """[half of the hash, lane (those of the length last), half of the lane]."""
    return np.random.Generator(np.random.PCG64(key)).integers(0, 1 << 64, (2, LONG // 8 + 2, 2), U64)


_LOW = U64(0xFFFFFFFF)


def _added(sums: np.ndarray, lane: np.ndarray, m: np.ndarray) -> None:
    low, high = lane & _LOW, lane >> U64(32)
    left, right = np.empty_like(low), np.empty_like(low)
    for k in (0, 1):
        np.add(low, m[k, 0], out=left)
        np.add(high, m[k, 1], out=right)
        left *= right
        sums[k] += left


def _folded(sums: np.ndarray) -> np.ndarray:
    return mix(sums[0] & ~_LOW | sums[1] >> U64(32))


def keyed_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """Hashes of the bytes start .. end - 1 of ``data`` under ``key``, for each pair of starts and ends."""
    size, m = ends - starts, multipliers(key)
    sums = np.zeros((2, len(size)), U64)
    long = size > LONG
    if long.any():
        first, parts = starts[long], -(-size[long] // LONG)
        at = np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(first, parts) + (np.arange(int(parts.sum())) - at) * LONG
        inner = keyed_hashes(data, begin, np.minimum(begin + LONG, np.repeat(ends[long], parts)), key + 1)
        last = np.cumsum(parts)
        sums[:, long] = keyed_hashes(inner.view(np.uint8), 8 * (last - parts), 8 * last, key + 2)
    view, short = lanes(data), np.flatnonzero(~long)
    for i in range(0, len(short), BLOCK):  # what the caches hold
        live = short[i : i + BLOCK]
        at, left, got, lane = starts[live], size[live], np.zeros((2, len(live)), U64), 0
        whole = int(left.min()) // 8 if len(left) else 0
        while lane < whole:  # lanes that all pieces have
            _added(got, view[at], m[:, lane])
            at, lane = at + 8, lane + 1
        left = left - 8 * whole
        while True:
            on = left > 0
            if not on.all():
                sums[:, live] = got
                live, at, left, got = live[on], at[on], left[on], got[:, on]
            if not len(live):
                break
            _added(got, view[at] & _MASKS[np.minimum(left, 8)], m[:, lane])
            at, left, lane = at + 8, left - 8, lane + 1
    _added(sums, size.astype(U64), m[:, -1])
    return _folded(sums)


def keyed_symbols(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """Hashes under ``key`` of the stretches start .. end - 1 of a sequence of 64-bit symbols."""
    return keyed_hashes(np.ascontiguousarray(symbols).view(np.uint8), starts * 8, ends * 8, key)


def keyed_grams(data: np.ndarray, k: int, key: int) -> np.ndarray:
    """Hashes under ``key`` of all ``k`` consecutive bytes, k being LONG at most."""
    n = len(data) - k + 1
    if n < 1:
        return np.zeros(0, U64)
    view, m, out = lanes(data), multipliers(key), np.empty(n, U64)
    for i in range(0, n, BLOCK):
        j = min(n, i + BLOCK)
        got = np.zeros((2, j - i), U64)
        for lane, at in enumerate(range(0, k, 8)):
            _added(got, view[at + i : at + j] & _MASKS[min(8, k - at)], m[:, lane])
        out[i:j] = _folded(got)
    return out


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k`` consecutive bytes. For k up to 8 no two different grams share one."""
    n = len(data) - k + 1
    if n < 1:
        return np.zeros(0, U64)
    view, out = lanes(data), np.empty(n, U64)
    for i in range(0, n, BLOCK):  # what the caches hold
        j = min(n, i + BLOCK)
        h = np.full(j - i, U64(k))
        for at in range(0, k, 8):
            h = _step(h, view[at + i : at + j] & _MASKS[min(8, k - at)])
        out[i:j] = mix(h)
    return out


def same_pieces(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from each start on are the same in ``a`` and in ``b``."""
    out = np.ones(len(size), bool)
    for i in np.flatnonzero(size > 16 * LONG):
        out[i] = np.array_equal(a[a_starts[i] : a_starts[i] + size[i]], b[b_starts[i] : b_starts[i] + size[i]])
    x, y = lanes(a), lanes(b)
    live = np.flatnonzero((size > 0) & (size <= 16 * LONG))
    p, q, left = a_starts[live], b_starts[live], size[live]
    while len(live):
        equal = ((x[p] ^ y[q]) & _MASKS[np.minimum(left, 8)]) == 0
        out[live[~equal]] = False
        on = equal & (left > 8)
        live, p, q, left = live[on], p[on] + 8, q[on] + 8, left[on] - 8
    return out


def grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of each distinct hash, number of each hash), numbered in ascending order."""
    by = np.argsort(hashes)
    if not len(by):
        return by, by
    new = np.r_[True, hashes[by[1:]] != hashes[by[:-1]]]
    of = np.empty(len(by), np.int64)
    of[by] = np.cumsum(new) - 1
    return by[new], of
