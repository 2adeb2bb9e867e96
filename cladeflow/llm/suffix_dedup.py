"""Operator 1, suffix-array dedup: a logarithmic family of sparse suffix arrays finds byte strings that occur before.

Documents come in batches of ascending doc_id. Of each batch the sampled suffixes (see ``repeats``: one for each
anchor, the minimum-hash 32-gram among the 69 of a 100-byte window, about one byte in 35) get a suffix array: they are sorted,
bucket by bucket, by the fingerprint of their first block and then of the stretch their windows cover. A new
array is merge-scanned against the levels that exist: what they hold is older, so a suffix found there repeats;
what is new is merged in, and arrays of equal size merge into one of double size, as the digits of a binary
counter carry. A suffix is thus rewritten about log2(batches) times. After the last batch the levels are scanned
against each other for suffixes that agree in the first block but not in all ("torn"): only for those, the rims
of repeats, are the bytes themselves read again and every 100-byte window compared.

Levels are tables bucketed by the suffix's bucket in the shared folder: scans and merges move no rows.

Rows: null text counts as empty; rows without doc_id are left out; of rows that share a doc_id the one with
the smallest text stands for all. Texts shorter than the window keep all their bytes. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .common import buckets_of, discard, drop_table, row_chunks, saved, shared_dir, text_bytes, tidy
from .hashing import U64, draw, keyed_grams

WIDTH, GRAM, BATCHES = 100, 32, 4
CHUNK, SEGMENT = 500_000, 1 << 19


def unique_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with each doc_id once: rows without an id go; of several the smallest text stays."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    again = docs.groupBy("doc_id").count().where("count > 1").limit(1)
    if again.isEmpty():
        return docs
    return docs.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in two passes."""
    n = len(values)
    x = np.concatenate([values, np.full(-n % width, U64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of pieces of rows in which every window of a row starts exactly once."""
    size = np.diff(offsets)
    pieces = np.maximum(1, -(-(size - width + 1) // SEGMENT))
    row = np.repeat(np.arange(len(size)), pieces)
    start = R.flat_ranges(np.zeros(len(size), np.int64), pieces) * SEGMENT if len(size) else np.zeros(0, np.int64)
    return row, start, np.minimum(start + SEGMENT + width - 1, size[row])


def byte_entries(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, width: int, gram: int, key: int) -> Iterator[R.Entries]:
    """Entries of all windows of the rows, some megabytes of text at a time."""
    row, start, end = segments(offsets, width)
    long = end - start >= width
    row, start, end = row[long], start[long], end[long]
    for i, j in row_chunks(np.r_[0, np.cumsum(end - start)], CHUNK):
        size = end[i:j] - start[i:j]
        base = np.cumsum(size) - size
        text = data[R.flat_ranges(offsets[row[i:j]] + start[i:j], size)] if j - i > 1 else data[offsets[row[i]] + start[i] : offsets[row[i]] + end[i]]
        grams = keyed_grams(text, gram, key)
        low = U64(0xFFFFFF)  # positions in a chunk take 24 bits, so that the leftmost minimum wins
        least = window_minima((grams & ~low) | np.arange(len(grams), dtype=U64), width - gram + 1)
        n = size - width + 1
        windows = R.flat_ranges(base, n)
        anchor = (least[windows] & low).astype(np.int64)
        yield R.entries_of(windows, anchor, grams[anchor], np.repeat(ids[row[i:j]], n), R.flat_ranges(start[i:j], n), text, width, key + 10)


def _index(width: int, gram: int, buckets: int, key: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[R.Entries]:
            for b in batches:
                data, offsets = text_bytes(b.column("text"))
                yield from byte_entries(data, offsets, b.column("doc_id").to_numpy(zero_copy_only=False), width, gram, key)

        return R.packed_batches(parts(), width, True, buckets)

    return run


def _sort(width: int):
    """The suffix array of a bucket's part of a batch."""

    @tidy
    def run(key: tuple, table: pa.Table) -> pa.Table:
        kept, spans = R.split_firsts(R.unpack(table, 0), True, width)
        old = R.unpack(table, 1)
        spans = R.merged(np.r_[spans["doc"], old["doc"]], np.r_[spans["pos"], old["pos"]], np.r_[spans["print"], old["print"]].astype(np.int64))
        bucket = key[0].as_py()
        return pa.Table.from_batches([R.pack([(bucket, 0, kept), (bucket, 1, spans)])], R.PACKED_ARROW)

    return run


def _scan(width: int, merge: bool, close: bool):
    """New array against an older level: what the level holds repeats. merge: one array of both; close: torn entries instead."""

    @tidy
    def run(key: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
        a, b = R.unpack(new, 0), R.unpack(old, 0)
        both = {f: np.concatenate([b[f], a[f]]) for f in R.FIELDS}
        by, keep, _ = R.firsts(both, True)
        rest = by[~keep]
        spans = [R.unpack(new, 1), R.unpack(old, 1) if merge or close else None, R.merged(both["doc"][rest], both["pos"][rest], both["pos"][rest] + both["len"][rest] + width - 1)]
        spans = [s for s in spans if s is not None]
        found = R.merged(*(np.concatenate([s[f] for s in spans]).astype(np.int64) for f in ("doc", "pos", "print")))
        at = by[keep]
        if not merge and not close:
            at = at[at >= len(b["doc"])]
        kept = R.take(both, at)
        bucket = key[0].as_py()
        rows = [(bucket, 1, found), *(R.torn_rows(bucket, kept) if close else [(bucket, 0, kept)])]
        return pa.Table.from_batches([R.pack(rows)], R.PACKED_ARROW)

    return run


class Levels:
    """The index family: digit i of the counter holds an array of 2^i batches, or none."""

    def __init__(self, spark, buckets: int, width: int):
        self.spark, self.buckets, self.width, self.digits = spark, buckets, width, {}
        self.live: set[str] = set()

    def table(self, df: DataFrame) -> str:
        name = f"suffix_level_{uuid.uuid4().hex}"
        self.live.add(name)
        df.repartition(self.buckets, "bucket").write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(self.spark)}/{name}").bucketBy(self.buckets, "bucket").saveAsTable(name)
        return name

    def pair(self, new: str, old: str, merge: bool, close: bool = False) -> DataFrame:
        read = self.spark.table
        return read(new).groupBy("bucket").cogroup(read(old).groupBy("bucket")).applyInArrow(_scan(self.width, merge, close), R.PACKED)

    def drop(self, name: str) -> None:
        drop_table(self.spark, name)
        self.live.discard(name)

    def clear(self) -> None:
        for name in list(self.live):
            self.drop(name)

    def insert(self, batch: DataFrame) -> None:
        """Scan against every level, newest first; carry while the digit is taken."""
        new, digit, carrying = self.table(batch), 0, True
        for at in sorted(self.digits):
            carrying = carrying and at == digit
            old = self.digits[at]
            out = self.table(self.pair(new, old, merge=carrying))
            self.drop(new)
            if carrying:
                self.drop(self.digits.pop(at))
                digit += 1
            new = out
        self.digits[digit] = new

    def close(self) -> DataFrame:
        """Repeated stretches (kind 1) and torn entries (kinds 2 and 3) of the whole family."""
        names = [self.digits[d] for d in sorted(self.digits)]
        while len(names) > 2:
            out = self.table(self.pair(names[0], names[1], merge=True))
            self.drop(names[0])
            self.drop(names[1])
            names[:2] = [out]
        if len(names) == 1:
            names.append(self.table(self.spark.createDataFrame([], R.PACKED)))
        out = saved(self.pair(names[0], names[1], merge=True, close=True), "suffix-close")
        for n in names:
            self.drop(n)
        return out


def torn_entries(closed: DataFrame) -> DataFrame:
    """Torn entries, one row each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind in (2, 3):
                e = R.unpack(b, kind)
                if len(e["doc"]):
                    yield pa.record_batch([pa.array(e["doc"]), pa.array(e["pos"]), pa.array(e["len"]), pa.array(e["symbol"].view(np.int64)), pa.array(np.full(len(e["doc"]), kind == 3))], names=["doc_id", "pos", "len", "symbol", "hot"])

    return closed.where("kind IN (2, 3)").mapInArrow(rows, "doc_id long, pos long, len int, symbol long, hot boolean")


TORN = ("pos", "len", "symbol", "hot")


def torn_by_document(closed: DataFrame) -> DataFrame:
    return torn_entries(closed).groupBy("doc_id").agg(*(F.collect_list(c).alias(c) for c in TORN))


def torn_of(batch: pa.RecordBatch) -> tuple[R.Entries, np.ndarray]:
    """Entries of a batch of documents joined with torn_by_document, and the row of each."""
    cols = {c: batch.column(c) for c in TORN}
    n = np.diff(cols["pos"].offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), n)
    flat = {c: v.flatten().to_numpy(zero_copy_only=False) for c, v in cols.items()}
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    return {"doc": ids[row], "pos": flat["pos"].astype(np.int64), "len": flat["len"].astype(np.int32), "symbol": np.ascontiguousarray(flat["symbol"]).view(U64), "hot": flat["hot"]}, row


def _torn_bytes(width: int, buckets: int, key: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            e, row = torn_of(b)
            yield R.content_batch(e, offsets[row] + e["pos"], R.Units(data), width, buckets, key)

    return run


def compare_windows(content: DataFrame, buckets: int, words: bool, width: int, within: bool, run_key: int) -> DataFrame:
    @tidy
    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([R.span_batch(R.repeated_windows(table, words, width, within, run_key))], R.SPANS_ARROW)

    return content.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, R.SPANS)


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """(doc_id, spans): the stretches of each document that windows starting earlier cover; documents without any are left out."""
    spark = docs.sparkSession
    buckets, key = buckets_of(docs), draw()
    edges = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.001) if batches > 1 else []
    levels = Levels(spark, buckets, width)
    low = None
    try:
        for high in [*sorted(set(edges)), None]:
            part = docs if low is None else docs.where(F.col("doc_id") > int(low))
            part = part if high is None else part.where(F.col("doc_id") <= int(high))
            low = high
            packed = part.mapInArrow(_index(width, gram, buckets, key), R.PACKED)
            levels.insert(packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_sort(width), R.PACKED))
        closed = levels.close()
    finally:
        levels.clear()
    torn = docs.join(torn_by_document(closed), "doc_id").mapInArrow(_torn_bytes(width, buckets, key), R.CONTENT)
    found = saved(compare_windows(torn, buckets, False, width, True, key).unionByName(closed.where("kind = 1").mapInArrow(R.unpack_spans, R.SPANS)), "suffix-spans")
    discard(closed)
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_bytes(b.column("text"))
        rows = []
        for i, (doc, spans) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("spans").to_pylist(), strict=True)):
            text = data[offsets[i] : offsets[i + 1]]
            s = R.merged(np.zeros(len(spans or [])), np.array([x["start"] for x in spans or []], np.int64), np.array([x["end"] for x in spans or []], np.int64))
            gone = [(int(x), int(y)) for x, y in zip(s["pos"], s["print"], strict=True)]
            sha, at = hashlib.sha256(), 0
            for x, y in [*gone, (len(text), len(text))]:
                sha.update(text[at:x].tobytes())
                at = y
            rows.append((doc, len(text), sum(y - x for x, y in gone), len(gone), sha.hexdigest(), [{"start": x, "end": y} for x, y in gone]))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def dedup_substrings(documents: DataFrame, width: int = WIDTH, batches: int = BATCHES) -> DataFrame:
    """Per document: its bytes, those removed, the removed runs and the hash of what is kept (see the module)."""
    docs = unique_documents(documents)
    return docs.join(repeated_spans(docs, width, min(GRAM, max(1, width // 2)), batches), "doc_id", "left").mapInArrow(_remove, DIGEST)


__all__ = ["dedup_substrings", "repeated_spans", "shared_dir", "unique_documents"]
