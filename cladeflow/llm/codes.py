"""Operator 11, vector code compression: product codes whose nearest entries are found by equal-average search.

A vector's components become integers floor(scale * x) and are cut into equal consecutive parts. Each part position has a codebook of its
own, which starts as that part of the vectors with the smallest ids and is moved a few rounds to the floored means of the parts assigned to it.

Search: a codebook's entries are sorted by the sum of their components. A part looks outward from its own sum, to lesser and to
greater sums, and a direction ends where (gap of the sums)^2 / dimension strictly exceeds the best squared distance so far: no entry
beyond can be as near (Cauchy-Schwarz). Entries on the bound are still compared, so ties go to the lower index exactly.

Each round is one pass over the vectors; a task sends the sums of its parts by (part, entry), whose number is that of the
codebooks, and the codebooks (parts x entries, a set size) are all that the driver holds.

Rows: vectors that are null, empty, or hold null or non-finite components are left out, so are rows without vec_id. Vectors whose length parts
doesn't divide, or whose length differs from that of the smallest vec_id's vector that it does divide, have no part in its codebooks and
are left out too. Integers beyond +-limit(dimension of a part), 2^26 for parts of four, count as that, so that squares stay whole numbers of 64 bits. Rows that
share a vec_id are vectors of their own, in the order of their components. Fewer vectors than entries: as many entries as
vectors. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: rows of a batch that are searched at a time, and shares that a label's rows are dealt to when its sum comes back
ROWS, SHARES = 8192, 64


def limit(dim: int) -> int:
    """The largest component of a part of ``dim``: squared gaps of sums stay under 2^62."""
    return 1 << (29 - dim.bit_length())


def whole_numbers(vectors: np.ndarray, scale: int, dim: int) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -limit(dim), limit(dim)).astype(np.int64)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry of ``book`` (the lowest of ties) and the squared distance, by equal-average search."""
    n, (entries, dim) = len(parts), book.shape
    sums = book.sum(1)
    order = np.argsort(sums, kind="stable")
    ranked, sums = book[order], sums[order]
    own = parts.sum(1)
    best, index = np.full(n, (1 << 62) // dim), np.full(n, entries)
    first = np.searchsorted(sums, own)
    for step, place, live in ((1, first.copy(), np.arange(n)), (-1, first - 1, np.arange(n))):
        while True:
            live = live[(place[live] >= 0) & (place[live] < entries)]
            gap = sums[place[live]] - own[live]
            live = live[gap * gap <= best[live] * dim]
            if not len(live):
                break
            at = place[live]
            apart = ranked[at] - parts[live]
            far, number = np.einsum("ij,ij->i", apart, apart), order[at]
            better = (far < best[live]) | ((far == best[live]) & (number < index[live]))
            best[live[better]], index[live[better]] = far[better], number[better]
            place[live] += step
    return index, best


def assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, parts, indexes, errors) of batches, [row, part] each."""
    parts, _, dim = books.shape
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            b = whole.slice(i, ROWS)
            cut = whole_numbers(b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, parts * dim), scale, dim).reshape(b.num_rows, parts, dim)
            found = [nearest(cut[:, p], books[p]) for p in range(parts)]
            yield b, cut, np.stack([x for x, _ in found], 1), np.stack([x for _, x in found], 1)


def _sums(books: np.ndarray, scale: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, dim = books.shape
        total, count = np.zeros((parts * entries, dim), np.int64), np.zeros(parts * entries, np.int64)  # a batch's sums stay under 2^53
        for _, cut, index, _ in assigned(batches, books, scale):
            at = (index + np.arange(parts) * entries).ravel()
            for d in range(dim):
                total[:, d] += np.bincount(at, weights=cut[:, :, d].ravel(), minlength=len(total)).astype(np.int64)
            count += np.bincount(at, minlength=len(count))
        some = np.flatnonzero(count)
        for d in range(dim):
            yield pa.record_batch([pa.array(some * dim + d), pa.array(total[some, d]), pa.array(count[some])], names=["place", "total", "n"])

    return run


def _codes(books: np.ndarray, scale: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{k:02x}" for k in range(256)])
        for b, _, index, far in assigned(batches, books, scale):
            code = ["".join(row) for row in digits[index].tolist()]
            yield pa.record_batch([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array(far.sum(1))], names=["vec_id", "label", "code", "error"])

    return run


def usable(vectors: DataFrame, parts: int) -> DataFrame:
    """(vec_id, label, embedding as doubles) of the vectors that can be coded."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where((F.size(x) > 0) & (F.size(x) % parts == 0) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.cast("array<double>").alias("embedding"))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """Codebooks [part, entry, place in the part] after ``rounds`` rounds over all usable vectors; None where there are none."""
    kept = usable(vectors, parts)
    least = kept.orderBy("vec_id", "embedding").limit(1).collect()
    if not least:
        return None
    kept = kept.where(F.size("embedding") == len(least[0]["embedding"]))
    seeds = kept.orderBy("vec_id", "embedding").limit(entries).collect()  # a set number of vectors
    start = whole_numbers(np.array([r["embedding"] for r in seeds]), scale, len(least[0]["embedding"]) // parts)
    books = np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        moved = kept.mapInArrow(_sums(books, scale), "place long, total long, n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        at, total, n = (moved.column(c).to_numpy() for c in ("place", "total", "n"))
        books = books.copy()
        books.reshape(-1)[at] = total // n
    return books


def encode(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error): codes of all usable vectors of the codebooks' length."""
    kept = usable(vectors, books.shape[0]).where(F.size("embedding") == books.shape[0] * books.shape[2])
    label = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(_codes(books, scale), f"vec_id long, label {label}, code string, error long")


def decode(code: str, books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for, at the middle of its components' cells."""
    return (np.concatenate([books[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(books))]) + 0.5) / scale


def digest(books: np.ndarray) -> str:
    """Lowercase hex sha256 of all entries' integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_sums(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over equal keys (nulls together): summed before they move, and given back to SHARES shares of each key, so no key's rows come together."""
    same: Column = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"))
    total = rows.groupBy(same.alias("_key")).agg(F.sum(value).alias(name)).withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    dealt = rows.withColumn("_none", F.col(key).isNull()).withColumn("_share", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SHARES)).cast("int"))
    total = total.select(F.col("_key.none").alias("_none_t"), F.col("_key.key").alias("_key_t"), F.col("_share").alias("_share_t"), name)
    return dealt.join(total, (F.col("_none") == F.col("_none_t")) & (F.col("_share") == F.col("_share_t")) & F.col(key).eqNullSafe(F.col("_key_t"))).drop("_none", "_share", "_none_t", "_share_t", "_key_t")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of all usable vectors (see the module). entries: at most 256."""
    if not 0 < entries <= 256:
        raise ValueError("an index is written as two hex digits: 1 to 256 entries")
    books = train(vectors, parts, entries, rounds, scale)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = saved(encode(vectors, books, scale), "codes")
    return with_sums(coded, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
