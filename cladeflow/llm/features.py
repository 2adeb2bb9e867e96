"""Sparse text and page-metadata features for the trained operators, and small numpy models over bounded samples.

A document's features are pairs (index, value) in a hashed space. Extraction runs inside tasks over all rows; only the
samples that models are fitted on, whose size is a parameter, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, flat_ranges, lists, row_chunks, text_bytes, word_bounds
from .hashing import U64, mix, piece_hashes

CHUNK = 400_000
_byte = np.arange(256)
ALNUM = ((_byte >= 48) & (_byte < 58)) | ((_byte >= 65) & (_byte < 91)) | ((_byte >= 97) & (_byte < 123)) | (_byte >= 128)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: classes of bytes in the shape of a word: a letter's case, a digit, a byte of a longer character; other signs stand for themselves
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[48:58], SHAPE[128:] = 65, 97, 48, 128


@dataclass
class Sparse:
    """Rows of (index, value) pairs, one after the other; ``offsets`` has a cut before each row and one at the end."""

    index: np.ndarray
    value: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self)), np.diff(self.offsets)), w[self.index] * self.value, len(self))

    def back(self, rows: np.ndarray, size: int) -> np.ndarray:
        """Sum of the rows, each times its number."""
        return np.bincount(self.index, self.value * np.repeat(rows, np.diff(self.offsets)), size)

    def take(self, rows: np.ndarray) -> Sparse:
        n = np.diff(self.offsets)[rows]
        at = flat_ranges(self.offsets[:-1][rows], n)
        return Sparse(self.index[at], self.value[at], np.r_[0, np.cumsum(n)])


def counted(row: np.ndarray, index: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, count) of the distinct pairs, in order."""
    key, count = np.unique(row * size + index, return_counts=True)
    return key // size, key % size, count


def words(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded words of letters and digits: (row, index, count)."""
    starts, ends, n = word_bounds(data, offsets, ~ALNUM)
    names = piece_hashes(FOLD[data], starts, ends)
    return counted(np.repeat(np.arange(len(n)), n), (names % U64(size)).astype(np.int64), len(n), size)


def words_and_stems(data: np.ndarray, offsets: np.ndarray, size: int, stems: tuple[int, ...] = (4, 5, 6)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded words, and the first 4, 5 and 6 bytes of longer ones, which inflected and compounded forms share: (row, index, count)."""
    starts, ends, n = word_bounds(data, offsets, ~ALNUM)
    folded = FOLD[data]
    row = np.repeat(np.arange(len(n)), n)
    rows, names = [row], [piece_hashes(folded, starts, ends)]
    for k in stems:
        long = ends - starts > k
        rows.append(row[long])
        names.append(piece_hashes(folded, starts[long], starts[long] + k, seed=1))
    return counted(np.concatenate(rows), (np.concatenate(names) % U64(size)).astype(np.int64), len(n), size)


def shapes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shapes of words between white space (classes of bytes, runs as one): (row, index, count)."""
    starts, ends, n = word_bounds(data, offsets)
    kind = SHAPE[data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    place = np.r_[0, np.cumsum(new)]
    names = piece_hashes(kind[new], place[starts], place[ends])
    return counted(np.repeat(np.arange(len(n)), n), (names % U64(size)).astype(np.int64), len(n), size)


def stacked(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int) -> Sparse:
    row, index, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(row, kind="stable")
    return Sparse(index[by].astype(np.int32), value[by].astype(np.float32), np.searchsorted(row[by], np.arange(rows + 1)))


def unit(row: np.ndarray, index: np.ndarray, count: np.ndarray, rows: int, first: int, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log counts at indexes from ``first`` on, each row of Euclidean length ``weight``."""
    v = np.log1p(count)
    norm = np.sqrt(np.bincount(row, v * v, rows))
    return row, index + first, weight * v / np.maximum(norm, 1e-9)[row]


TEXT_WORDS, TEXT_SHAPES = 1 << 15, 1 << 12
TEXT_SIZE = TEXT_WORDS + TEXT_SHAPES


def text_view(data: np.ndarray, offsets: np.ndarray) -> Sparse:
    """Content: words and word shapes."""
    n = len(offsets) - 1
    return stacked([unit(*words(data, offsets, TEXT_WORDS), n, 0), unit(*shapes(data, offsets, TEXT_SHAPES), n, TEXT_WORDS, 2.0)], n)


META_SIZE = 1 << 12


def named(name: str, values: np.ndarray) -> np.ndarray:
    """Indexes of the features "name = value"."""
    return (mix(values.astype(np.int64).view(U64) ^ U64(sum(b << (8 * (i % 8)) for i, b in enumerate(name.encode())) & (2**64 - 1))) % U64(META_SIZE)).astype(np.int64)


def meta_view(data: np.ndarray, offsets: np.ndarray, source: pa.Array, lang: pa.Array) -> Sparse:
    """Page metadata: source, language, and the page's layout in coarse steps (length, lines, shares of kinds of bytes)."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    share = {}
    for k, of in (("space", WHITE), ("upper", (_byte >= 65) & (_byte < 91)), ("digit", (_byte >= 48) & (_byte < 58)), ("sign", ~ALNUM & ~WHITE), ("line", _byte == 10)):
        sums = np.r_[0, np.cumsum(of[data])]
        share[k] = sums[offsets[1:]] - sums[offsets[:-1]]
    starts, _, n_words = word_bounds(data, offsets)
    cols = [named("length", np.log2(size + 1).astype(np.int64))]
    cols += [named(k, np.round(24 * np.sqrt(v / np.maximum(size, 1))).astype(np.int64)) for k, v in share.items()]
    cols.append(named("word", np.round(4 * np.log2(1 + size / np.maximum(n_words, 1))).astype(np.int64)))
    for name, col in (("source", source), ("lang", lang)):
        text, cuts = text_bytes(col)
        cols.append(named(name, piece_hashes(text, cuts[:-1], cuts[1:]).view(np.int64)))
    index = np.stack(cols, 1)
    return Sparse(index.ravel().astype(np.int32), np.full(index.size, 1 / np.sqrt(index.shape[1]), np.float32), np.arange(n + 1) * index.shape[1])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches in slices of a few hundred kilobytes of text, with its bytes and cuts."""
    for b in batches:
        data, offsets = text_bytes(b.column("text"))
        for i, j in row_chunks(offsets, CHUNK):
            yield b.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def sparse_lists(x: Sparse) -> tuple[pa.ListArray, pa.ListArray]:
    n = np.diff(x.offsets)
    return lists(x.index, n, pa.int32()), lists(x.value, n, pa.float32())


def gathered(table: pa.Table, name: str) -> Sparse:
    """A collected pair of list columns as rows again."""
    index, value = (table.column(f"{name}_{x}").combine_chunks() for x in ("index", "value"))
    if not len(index):
        return Sparse(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64))
    n = np.diff(index.offsets.to_numpy())
    return Sparse(index.flatten().to_numpy(), value.flatten().to_numpy(), np.r_[0, np.cumsum(n)])


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """``bound`` rows at most, those of the least hashed key: the same rows in every run, whatever the partitions."""
    return df.withColumn("__rank", F.xxhash64(F.lit(seed), F.col(key))).orderBy("__rank", key).limit(bound).drop("__rank")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: Sparse, y: np.ndarray, size: int, weight: np.ndarray | None = None, start: np.ndarray | None = None, steps: int = 80, penalty: float = 1e-5, rate: float = 0.3) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression: Adam over the whole sample, decaying steps."""
    w = np.zeros(size + 1) if start is None else start.copy()
    if not len(y):
        return w
    weight = np.ones(len(y)) if weight is None else weight
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        err = weight * (sigmoid(x.dot(w[:-1]) + w[-1]) - y) / weight.sum()
        g = np.r_[x.back(err, size) + penalty * w[:-1], err.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate / np.sqrt(1 + t / 20) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def fit_platt(score: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[float, float]:
    """(a, b) of the calibrated probability sigmoid(a * score + b), by Newton's method with smoothed targets."""
    if len(y) < 4 or y.min() == y.max():
        return 1.0, 0.0
    up, down = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(float(np.std(score)), 1e-9)
    z = np.stack([score / scale, np.ones(len(score))], 1)
    w = np.zeros(2)
    for _ in range(min(steps, 60)):
        p = sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, z.T @ (p - target)), -2, 2)
    return float(w[0] / scale), float(w[1])
