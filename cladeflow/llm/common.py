"""Helpers that the corpus operators share: tables in the shared folder, text buffers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where a local session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(spark, "_cladeflow_dir", None):
        spark._cladeflow_dir = "file://" + tempfile.mkdtemp(prefix="spark-cladeflow-")
    return spark._cladeflow_dir


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, a lost executor only costs
    the tasks at hand, and the shuffle files behind it go as soon as the table stands."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def saved_by(df: DataFrame, name: str, key: str, buckets: int, moved: bool = False) -> DataFrame:
    """Write ``df`` to a table in the shared folder, bucketed by ``key``, and read it back: grouping by the key moves no rows.
    moved: whether the rows are dealt by the key already, as grouping by it leaves them."""
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df if moved else df.repartition(buckets, key)).write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").bucketBy(buckets, key).saveAsTable(table)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.table(table)
    out._cladeflow_table = table
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by ``saved`` or ``saved_by`` that no later step reads."""
    spark = df.sparkSession
    if table := getattr(df, "_cladeflow_table", None):
        drop_table(spark, table)
        return
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if path.startswith("file:") or "://" in path:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(spark: SparkSession, table: str) -> None:
    """Drop a table of the shared folder with its files; one that is gone stays gone."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    _delete(spark, f"{shared_dir(spark)}/{table}")


def _release() -> None:
    """Give freed memory back to the system: workers live on after their tasks, and the next stage needs the room."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(f):
    """A task's function that leaves no freed memory behind: of batches, of (key, table) or of (key, table, table)."""

    def rows(batches):
        yield from f(batches)
        _release()

    def group(key, table):
        out = f(key, table)
        _release()
        return out

    def pair(key, left, right):
        out = f(key, left, right)
        _release()
        return out

    return {1: rows, 2: group, 3: pair}[f.__code__.co_argcount]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: bytes of text for each bucket that what is found in texts is dealt to
BUCKET_TEXT = 64 << 20


def buckets_of(documents: DataFrame) -> int:
    """Buckets for what is found in the texts: as many as the session's shuffle partitions, or more where the texts are large."""
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return max(partitions(documents.sparkSession), -(-int(size) // BUCKET_TEXT))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, one after the other, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes each (a longer row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = j


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words ``[^\\x20\\x09-\\x0D]+`` (or runs of bytes not in ``between``) and the number of words of each row."""
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~between[data]
    edge = np.diff(inside)
    starts, ends = edge[:-1] == 1, edge[1:] == -1
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    starts[cut] = inside[1:-1][cut] == 1  # a word never runs over the end of its row
    ends[cut - 1] = inside[1:-1][cut - 1] == 1
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def flat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for every row, one after the other."""
    total = int(counts.sum())
    begin = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - begin, counts)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
