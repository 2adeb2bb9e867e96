"""Shingle sets of documents, and slices of them that near pairs must share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import flat_ranges, row_chunks, text_bytes, word_bounds
from .hashing import U64, keyed_hashes, keyed_symbols, mix

CHUNK = 400_000
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes under ``key``, how many each row has): distinct ``words``-word shingles of each row, A-Z folded, ascending.

    A row of fewer words has its whole sequence as one shingle; a row without words has none."""
    data = FOLD[data]
    starts, ends, n = word_bounds(data, offsets)
    names = keyed_hashes(data, starts, ends, key)
    first = np.cumsum(n) - n
    some = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    at = flat_ranges(first, some)
    row = np.repeat(np.arange(len(n)), some)
    size = np.minimum(words, n)[row]
    value = keyed_symbols(names, at, at + size, key + 10)
    by = np.lexsort((value, row))
    value, row = value[by], row[by]
    new = np.ones(len(by), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.bincount(row[new], minlength=len(n))


def set_prints(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit prints of each set, whatever its order."""
    cut = np.r_[0, np.cumsum(counts)]
    a, b = np.r_[U64(0), np.cumsum(mix(values))], np.r_[U64(0), np.cumsum(mix(values ^ U64(0xABCDEF0123456789)))]
    return a[cut[1:]] - a[cut[:-1]], b[cut[1:]] - b[cut[:-1]]


def set_batches(batches: Iterator[pa.RecordBatch], words: int, key: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_id, hashes, counts), a few hundred kilobytes of text at a time."""
    for b in batches:
        data, offsets = text_bytes(b.column("text"))
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        for i, j in row_chunks(offsets, CHUNK):
            yield ids[i:j], *shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words, key)


RATIO = 1.5


def size_class(sizes: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(sizes, 1)) / np.log(RATIO) + 1e-9).astype(np.int64)


def slice_numbers(sizes: np.ndarray, cls: np.ndarray, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(slices, least number that similar sets share) for sets of these sizes cut for size class ``cls``."""
    a, b = similarity
    top = np.ceil(RATIO ** (cls + 1.0) + 1e-6)  # sizes of the class are below
    differ = np.floor(top * (b - a) / a).astype(np.int64)
    spare = np.ceil((differ + 1) * min(0.25, 1.25 * (b - a) / b)).astype(np.int64) + 2
    return differ + 1 + spare, spare + 1


def slices(values: np.ndarray, counts: np.ndarray, similarity: tuple[int, int]) -> dict[str, np.ndarray]:
    """Prints of slices of each set: sig, row and of (its size class) of each slice; set (row), cls, empty and need of each (set, size class) cut.

    Sets of Jaccard similarity of at least a / b, ``similarity`` (a, b), differ in at most d = floor(size * (b - a) / a) elements,
    size being the smaller one's. Elements are hashed to m = d + need slices, so at least ``need`` slices of such a pair are
    equal. d follows from a size class; a set that may have partners in the next class is cut for that class too. Slices
    without elements are not given; a set whose dropped slices, empty or otherwise, are fewer than ``need`` shares
    one of the others with every partner."""
    a, b = similarity
    out: dict[str, list[np.ndarray]] = {f: [] for f in ("sig", "row", "of", "set", "cls", "empty", "need")}
    kind = size_class(counts)
    row_of = np.repeat(np.arange(len(counts)), counts)
    for up in (0, 1):
        cls = kind + up
        low = np.floor(RATIO ** cls.astype(float) - 1e-6)
        use = (counts > 0) & ((up == 0) | (counts * b >= low * a))
        m, need = slice_numbers(counts, cls, similarity)
        cut = np.where(use, m, 0)
        base = np.cumsum(cut) - cut
        of = np.flatnonzero(use[row_of])
        r, v = row_of[of], mix(values[of] ^ U64(0x5EED))
        place = base[r] + ((v >> U64(32)) * m[r].astype(U64) >> U64(32)).astype(np.int64)
        got, held = np.zeros(int(cut.sum()), U64), np.zeros(int(cut.sum()), bool)
        np.add.at(got, place, mix(v))
        held[place] = True
        owner = np.repeat(np.arange(len(counts)), cut)
        number = flat_ranges(np.zeros(len(counts), np.int64), cut)
        out["sig"].append(mix(got + mix((cls[owner].astype(U64) << U64(32)) + number.astype(U64)))[held])
        out["row"].append(owner[held])
        out["of"].append(cls[owner[held]])
        some = np.flatnonzero(use)
        out["set"].append(some)
        out["cls"].append(cls[some])
        out["empty"].append(np.bincount(owner[~held], minlength=len(counts))[some])
        out["need"].append(need[some])
    return {f: np.concatenate(v) for f, v in out.items()}
