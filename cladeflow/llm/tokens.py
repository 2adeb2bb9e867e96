"""Operator 9, token-ID output: documents as ORC files of token ids, and readers of those files.

Documents are range-partitioned and sorted by doc_id, encoded, and written by Spark's ORC writer: integer run-length
encoding in stripes, row indexes every ``stride`` rows and Bloom filters on doc_id, so a reader takes stripes in
parallel and a search for one doc_id skips stripes and row groups by their statistics. ``start`` is a document's place in the
stream of all ids: the partitions' sums (one row each) give each partition its base.

Encoding splits texts at ASCII blanks and encodes each distinct piece once in a worker's memory: the vocabulary's
pre-tokenizer never joins tokens over a blank, so the ids are those of the whole text.

Rows: null text counts as empty, giving the end id alone. Each row is written: a null doc_id comes first, rows that share a doc_id
in the order of their texts. An empty table gives empty files. Other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets_of, flat_ranges, lists, row_chunks, shared_dir, text_bytes, tidy, word_bounds
from .hashing import U64, piece_hashes, same_pieces

#: distinct units that a worker remembers (about 40 bytes each with its ids and its own bytes) before it starts anew
REMEMBER, REMEMBER_BYTES = 1_200_000, 40 << 20
TEXT = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: bytes whose presence keeps a unit as it is: characters beyond U+00FF and controls (composition must not be disturbed), and "<" (special tokens)
_FIXED = np.zeros(256, bool)
_FIXED[0xC4:] = _FIXED[0xC2] = _FIXED[0x3C] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces that can be encoded one by one, and how many each row has.

    Blanks separate pieces; a full stop or comma that ends a piece after a letter (ASCII or U+00C0 .. U+00FF) is one of its own,
    since the vocabulary never joins letters and signs."""
    starts, ends, n = word_bounds(data, offsets, _BLANK)
    if not len(starts):
        return starts, ends, n
    tail = (data[ends - 1] == 46) | (data[ends - 1] == 44)
    before = data[np.maximum(ends - 2, 0)]
    latin = (data[np.maximum(ends - 3, 0)] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (ends - starts >= 3)
    cut = tail & (ends - starts >= 2) & (_ASCII[before] | latin)
    where = flat_ranges(np.cumsum(1 + cut) - (1 + cut), np.ones(len(cut), np.int64))
    s, e = np.empty(len(cut) + int(cut.sum()), np.int64), np.empty(len(cut) + int(cut.sum()), np.int64)
    s[where], e[where] = starts, ends - cut
    s[where[cut] + 1], e[where[cut] + 1] = ends[cut] - 1, ends[cut]
    row = np.repeat(np.arange(len(n)), n)
    return s, e, n + np.bincount(row[cut], minlength=len(n))


class Encoder:
    """Ids of texts; what a unit encodes to is remembered (ASCII in lower case, as the vocabulary folds case).

    Units are found again by hash and compared byte by byte; one that only shares a hash is encoded for itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks already take all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.names, self.pool, self.raw = np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.first, self.size, self.at, self.long = (np.zeros(0, np.int32) for _ in range(4))  # of each name: its ids in the pool, its bytes in raw

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(first, size) of the ids of each text, which are added to the pool."""
        got = []
        for i in range(0, len(texts), 4096):
            got += [e.ids for e in self.tokenizer.encode_batch(texts[i : i + 4096], add_special_tokens=False)]
        size = np.array([len(x) for x in got], np.int32)
        first = (len(self.pool) + np.cumsum(size) - size).astype(np.int32)
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(got), np.int32, int(size.sum()))])
        return first, size

    def learn(self, names: np.ndarray, texts: list[str], folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        first, size = self.tokens(texts)
        long = (ends - starts).astype(np.int32)
        at = (len(self.raw) + np.cumsum(long) - long).astype(np.int32)
        self.raw = np.concatenate([self.raw, folded[flat_ranges(starts, long)]])
        where = np.searchsorted(self.names, names)
        self.names = np.insert(self.names, where, names)
        self.first, self.size, self.at, self.long = (np.insert(x, where, y) for x, y in ((self.first, first), (self.size, size), (self.at, at), (self.long, long)))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each row has)."""
        starts, ends, n = units(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), n
        fixed = np.r_[0, np.cumsum(_FIXED[data])]
        keep = fixed[ends] > fixed[starts]
        folded = _FOLD[data]
        if keep.any():
            at = flat_ranges(starts[keep], (ends - starts)[keep])
            folded[at] = data[at]
        size = ends - starts
        names = unit_names(folded, starts, ends)
        distinct, one, of = np.unique(names, return_index=True, return_inverse=True)
        if len(self.names) + len(distinct) > REMEMBER or len(self.raw) + int(size[one].sum()) > REMEMBER_BYTES:
            self.forget()
        raw = data.tobytes()
        text = lambda at: [raw[x:y].decode() for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        new = one[~np.isin(distinct, self.names, assume_unique=True)]
        if len(new):
            self.learn(names[new], text(new), folded, starts[new], ends[new])
        known = np.searchsorted(self.names, distinct)
        same = self.long[known] == size[one]
        same[same] = same_pieces(folded, starts[one[same]], self.raw, self.at[known[same]], size[one[same]])
        alike = same[of] & (size == size[one[of]])
        alike[alike] = same_pieces(folded, starts[alike], folded, starts[one[of[alike]]], size[alike])
        first, many = self.first[known][of].astype(np.int64), self.size[known][of].astype(np.int64)
        if len(other := np.flatnonzero(~alike)):
            first[other], many[other] = self.tokens(text(other))
        total = np.r_[0, np.cumsum(many)]
        cut = np.r_[0, np.cumsum(n)]
        return self.pool[flat_ranges(first, many)], np.diff(total[cut])


def unit_names(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return piece_hashes(folded, starts, ends)


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process: what a task has learned serves the next."""
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def _encode(path: str, end_id: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = encoder(path), 0
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            for i, j in row_chunks(offsets, TEXT):
                ids, counts = with_end(*encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), end_id)
                yield pa.record_batch([b.column("doc_id").slice(i, j - i), pa.array(np.arange(row, row + j - i)), lists(ids, counts, pa.int32())], names=["doc_id", "row", "ids"])
                row += j - i

    return run


def write_tokens(documents: DataFrame, vocabulary: str, path: str, end_id: int = 1, stride: int = 1000, stripe_mb: int = 16) -> None:
    """Write ORC files of (doc_id, row in the file, ids) under ``path``, file after file in ascending doc_id."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # rows that share a doc_id, or have none, are dealt by how their texts begin
    ordered = docs.repartitionByRange(buckets_of(docs), "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(_encode(vocabulary, end_id), "doc_id long, row long, ids array<int>")
    (
        encoded.write.option("orc.compress", "ZSTD").option("orc.stripe.size", str(stripe_mb << 20)).option("orc.create.index", "true")
        .option("orc.row.index.stride", str(stride)).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)
    )


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """(doc_id, row, ids); with ``ids``, only those documents: the filter goes down to stripe statistics and Bloom filters."""
    out = spark.read.schema("doc_id long, row long, ids array<int>").orc(path)
    return out if ids is None else out.where(F.col("doc_id").isin(ids))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col = b.column("ids")
        offsets, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.record_batch([b.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64()), b.column("part"), b.column("row")], names=["doc_id", "n_tokens", "ids_crc32", "part", "row"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    # files hold ranges of doc_id in order; a file's number is its place
    read = read_tokens(spark, path).withColumn("part", F.col("_metadata.file_name"))
    rows = read.mapInArrow(_digest, "doc_id long, n_tokens long, ids_crc32 long, part string, row long")
    sums = read.groupBy("part").agg(F.sum(F.size("ids").cast("long")).alias("size"), F.min(F.struct("doc_id", "part")).alias("least"))
    bases = sums.withColumn("base", F.sum("size").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("base", F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(bases, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_output(documents: DataFrame, vocabulary: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write the files (in the shared folder unless ``path`` is given) and return what token_digest reads from them."""
    spark = documents.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(documents, vocabulary, path, end_id)
    return token_digest(spark, path)
