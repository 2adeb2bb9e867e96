"""Operator 12, Merkle dataset manifest: incremental witnesses over streaming aligned appends.

A leaf is the hash of a row's fields, each with its length. Leaves are appended in order to their series (a language), and nodes go in runs of
``ARITY``: a run that is full, or is the last, becomes its hash, up to the series' root; the series' roots are appended to a last tree in the same way.

A node's *witness* is what lies beside its path: the other nodes of its run, level by level. While a tree is open, a node that joins a run
starts with a partial witness, the siblings that stand before it, and each later sibling that is completed extends it. A task appends one aligned block of
``ARITY ** DEPTH`` leaves so; the blocks' roots, known for all blocks at once, are treated as further appends, DEPTH levels up, until one node is left.
A leaf's witness is its own inside the block, then its block root's. Texts never move: only hashes do, and a task holds one block.

``extend`` appends to a manifest that stands: full blocks keep their roots and inner witnesses, and only each series' open last block and the levels above are appended again.

Rows: every row is a leaf, also repeated ones, by (series, doc_id, leaf), nulls first. A null field is written as "-", an empty one as "0:".
One leaf alone is its series' root; no sibling at all gives the hash of nothing as proof. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import saved, tidy

ARITY, DEPTH = 8, 4
BLOCK = ARITY**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*hashes: str) -> str:
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """The hash of a row's fields, with ``text`` as its text."""
    return F.sha2(F.concat(*(field(text if f == "text" else F.col(f)) for f in FIELDS)), 256)


def tampered_leaf() -> Column:
    """The leaf after tampering: a third of the rows, by crc32 of doc_id, have their text's A-Z lower-cased."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(F.translate("text", UPPER, LOWER))).otherwise(leaf(F.col("text")))


# ---- one open tree


class OpenTree:
    """Nodes appended one after the other; ``siblings[level][i]`` is the (partial) witness of that level's node i."""

    def __init__(self) -> None:
        self.levels: list[list[str]] = [[]]
        self.siblings: list[list[list[str]]] = [[]]

    def append(self, node: str, level: int = 0) -> None:
        nodes, beside = self.levels[level], self.siblings[level]
        begin = len(nodes) // ARITY * ARITY
        for earlier in beside[begin:]:
            earlier.append(node)  # a later sibling that is completed extends them
        beside.append(nodes[begin:])  # the witness starts with those that stand before
        nodes.append(node)
        if len(nodes) % ARITY == 0:
            self._complete(level)

    def _complete(self, level: int) -> None:
        if level + 1 == len(self.levels):
            self.levels.append([])
            self.siblings.append([])
        begin = (len(self.levels[level]) - 1) // ARITY * ARITY
        self.append(digest(*self.levels[level][begin:]), level + 1)

    def close(self, height: int) -> str:
        """Complete the runs that are still open, ``height`` levels up; the root."""
        for level in range(height):
            if len(self.levels[level]) % ARITY:
                self._complete(level)
        return self.levels[height][0]

    def witness(self, i: int, height: int) -> str:
        """All siblings beside leaf i's path, level by level, left to right, one after the other."""
        return "".join("".join(self.siblings[level][i // ARITY**level]) for level in range(height))


def height_of(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def fold(node: str, pos: int, n: int, witness: str) -> str:
    """The root that a leaf at ``pos`` of n leaves gives with its witness."""
    at = 0
    while n > 1:
        own = pos % ARITY
        others = min(ARITY, n - (pos - own)) - 1
        cut, end = at + 64 * own, at + 64 * others
        node = digest(witness[at:cut], node, witness[cut:end])
        at, pos, n = end, pos // ARITY, -(-n // ARITY)
    return node


# ---- places


@tidy
def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range with its number and their places inside their series."""
    part, last, at = TaskContext.get().partitionId(), None, 0
    for b in batches:
        places: list[int] = []
        for one, group in groupby(b.column("series").to_pylist()):
            if one != last:
                last, at = one, 0
            k = sum(1 for _ in group)
            places.extend(range(at, at + k))
            at += k
        yield pa.record_batch([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(places, pa.int64())], names=[*b.schema.names, "part", "at"])


def positions(rows: DataFrame, order: list[str], taken: DataFrame | None = None) -> DataFrame:
    """``rows`` with pos and n: places from 0 in their series' ``order`` (nulls first) and the series' length, from sorted ranges and their counts, no series in one task.

    taken: (series, n), series whose first n places are taken already."""
    by = ["series", *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = saved(dealt.mapInArrow(_numbered, StructType([*rows.schema.fields, StructField("part", IntegerType()), StructField("at", LongType())])), "merkle-sorted")
    held = dealt.groupBy("series", "part").agg(F.count("*").alias("held"))  # a row for each range that a series is in
    ranges = Window.partitionBy("series")
    held = held.select("series", "part", F.coalesce(F.sum("held").over(ranges.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("held").over(ranges).alias("n"))
    if taken is not None:
        first = F.coalesce("_first", F.lit(0))
        held = held.join(taken.select("series", F.col("n").alias("_first")), "series", "left").select("series", "part", (F.col("before") + first).alias("before"), (F.col("n") + first).alias("n"))
    return dealt.join(held, ["series", "part"]).select(*rows.columns, (F.col("before") + F.col("at")).alias("pos"), "n")


# ---- blocks of trees as tasks

APPENDED = "series string, block long, pos long, n long, hash string, witness string, root string"


@tidy
def _append_block(key: tuple, table: pa.Table) -> pa.Table:
    """One aligned block: each node with its witness inside the block, and the block's root."""
    table = table.sort_by("pos")
    height = min(DEPTH, height_of(table.column("n")[0].as_py()))
    tree = OpenTree()
    for h in table.column("hash").to_pylist():
        tree.append(h)
    root = tree.close(height)
    out = table.append_column("witness", pa.array([tree.witness(i, height) for i in range(table.num_rows)], pa.string()))
    return out.append_column("root", pa.array([root] * table.num_rows, pa.string())).select(["series", "block", "pos", "n", "hash", "witness", "root"])


def appended(nodes: DataFrame) -> DataFrame:
    """``nodes`` (series, pos, n, hash) by blocks, with their witnesses inside the block and its root."""
    return nodes.select("series", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n", "hash").groupBy("series", "block").applyInArrow(_append_block, APPENDED)


def roots_of(blocks: DataFrame) -> DataFrame:
    """The blocks' roots as the nodes of the next append."""
    return blocks.where(F.col("pos") % BLOCK == 0).select("series", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("hash"))


def stacked(blocks: DataFrame) -> list[DataFrame]:
    """``blocks``, then the appends of their roots and of those roots' roots, until each series has one block."""
    levels = [blocks]
    while not levels[-1].where(F.col("n") > BLOCK).isEmpty():
        levels.append(saved(appended(roots_of(levels[-1])), "merkle-upper"))  # a series of one block has one node here, whose witness is empty
    return levels


TOP = ["root", "top_pos", "top_n", "top_witness", "subroot"]


def lowered(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Leaves with whole witnesses and TOP. What belongs to a series joins its highest block, and goes down from block roots to their blocks: no join
    has more than a block's rows of one key, however many of all rows a series holds."""
    out = levels[-1].drop("root").join(tops, "series")
    for lower in reversed(levels[:-1]):
        upper = out.select(F.col("series"), F.col("pos").alias("block"), F.col("witness").alias("_above"), *TOP)
        out = lower.drop("root").join(upper, ["series", "block"]).withColumn("witness", F.concat("witness", "_above")).drop("_above")
    return out


# ---- manifests


@dataclass
class Manifest:
    """Saved tables: leaves (series, doc_id, hash, tampered, pos, n), and the same nodes by blocks with their inner witnesses."""

    leaves: DataFrame
    blocks: DataFrame


def nodes_of(documents: DataFrame) -> DataFrame:
    """(series, doc_id, hash, tampered): a leaf for each row, hashed where its text is read. Series "0" is that of null, others are "1" and the language."""
    series = F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "lang"))
    return documents.select(*FIELDS).select(series.alias("series"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("hash"), tampered_leaf().alias("tampered"))


PLACE, ORDER = ["series", "pos", "n", "hash"], ["doc_id", "hash", "tampered"]


def build(documents: DataFrame) -> Manifest:
    """The manifest of ``documents``."""
    leaves = saved(positions(nodes_of(documents), ORDER), "merkle-leaves")
    return Manifest(leaves, saved(appended(leaves.select(*PLACE)), "merkle-blocks"))


def extend(manifest: Manifest, documents: DataFrame) -> Manifest:
    """The manifest with ``documents`` appended; in each series they must have greater doc_ids than what stands."""
    sizes = saved(manifest.leaves.groupBy("series").agg(F.max("n").alias("n"), F.max("doc_id").alias("last")), "merkle-sizes")
    new = nodes_of(documents)
    if not new.join(sizes, "series").where("doc_id IS NULL OR doc_id <= last").isEmpty():
        raise ValueError("documents to append need greater doc_ids than those of their language in the manifest")
    added = saved(positions(new, ORDER, sizes), "merkle-added")
    grown = added.groupBy("series").agg(F.max("n").alias("_n"))

    def now(rows: DataFrame) -> DataFrame:
        return rows.join(grown, "series", "left").withColumn("n", F.coalesce("_n", "n")).drop("_n").select(*rows.columns)

    leaves = saved(now(manifest.leaves).unionByName(added), "merkle-leaves")
    full = (F.col("block") + 1) * BLOCK <= F.col("n")  # by the length before
    again = leaves.join(manifest.blocks.where(full).select("series", "pos"), ["series", "pos"], "left_anti").select(*PLACE)
    return Manifest(leaves, saved(now(manifest.blocks.where(full)).unionByName(appended(again)), "merkle-blocks"))


def proofs(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, tampered, subroot, root, pos, n, witness, top_pos, top_n, top_witness) for every leaf."""
    levels = stacked(manifest.blocks)
    subroots = levels[-1].where("pos = 0").select(F.lit("").alias("series"), F.col("series").alias("of"), F.col("root").alias("hash"))
    ranked = saved(positions(subroots, ["of"]), "merkle-subroots")
    above = stacked(saved(appended(ranked.select(*PLACE)), "merkle-top"))
    top = lowered(above, _plain(above))
    tops = ranked.select("pos", F.col("of").alias("series"), F.col("hash").alias("subroot")).join(top.select("pos", "root", F.col("n").alias("top_n"), F.col("witness").alias("top_witness")), "pos").withColumnRenamed("pos", "top_pos")
    found = lowered(levels, tops.select("series", *TOP)).withColumnRenamed("hash", "leaf")
    return found.drop("n", "block").join(manifest.leaves.select("series", "pos", "n", "doc_id", "tampered"), ["series", "pos"]).drop("series")


def _plain(levels: list[DataFrame]) -> DataFrame:
    """TOP of a series that no tree stands above."""
    none = F.lit(None)
    return levels[-1].where("pos = 0").select("series", "root", none.cast("long").alias("top_pos"), none.cast("long").alias("top_n"), none.cast("string").alias("top_witness"), F.col("root").alias("subroot"))


CHECKED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


@tidy
def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        proof, folded = [], []
        for r in b.select(["tampered", "pos", "n", "witness", "top_pos", "top_n", "top_witness"]).to_pylist():
            proof.append(digest(r["witness"], r["top_witness"]))
            folded.append(fold(fold(r["tampered"], r["pos"], r["n"], r["witness"]), r["top_pos"], r["top_n"], r["top_witness"]))
        ok = [x == y for x, y in zip(folded, b.column("root").to_pylist(), strict=True)]
        kept = [b.column(c) for c in ("doc_id", "leaf", "subroot", "root")]
        yield pa.record_batch([*kept, pa.array(proof, pa.string()), pa.array(folded, pa.string()), pa.array(ok, pa.bool_())], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def verify(manifest: Manifest) -> DataFrame:
    """Each leaf with its proof's hash, the root that the tampered leaf gives with the original siblings, and whether that is the root."""
    return proofs(manifest).mapInArrow(_check, CHECKED)
