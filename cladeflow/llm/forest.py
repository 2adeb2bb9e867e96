"""Operator 5, embedding near-dedup with a forest of random-projection trees.

Vectors that are equal are one, with a count. A bounded sample (SAMPLE vectors) fits the trees: in each, a node sends a unit vector left or
right of the median of its sample's projections on a random direction (one for each level and tree); vectors within SPILL of the
median go both ways. Trees are as deep as leaves of about LEAF vectors ask for, whatever the number of vectors: below the depth
that the sample reaches, nodes take the median of their deepest ancestor's sample on the level's direction.

Tree after tree, all vectors are routed to their leaves and each leaf compares its members, all pairs in double precision; what a tree shuffles
goes before the next one. A leaf of over BLOCK members is compared in pairs of blocks, so a task holds two blocks at most and nothing is capped.

A pair that meets in several leaves is counted in the first only (by tree, then by leaf): leaves route their members again to tell, and give
each vector's number of links and a spanning forest of the links, never the pairs. Links' components follow by contraction.

Each length of vectors has its own forest, so vectors meet those of their length (a length of few vectors is a single leaf).

Rows: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; any other magnitude is compared
(vectors are scaled by their largest component first). Rows without vec_id are left out; a repeated vec_id counts once, with the
vector that sorts first. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, tidy
from .components import components, spanning
from .features import bounded_sample

TREES, LEAF, SPILL = 8, 300, 0.02
#: vectors that fit the trees, and those that a node needs to have a median of its own
SAMPLE, OWN = 20_000, 16
BLOCK = 2048


@dataclass
class Forest:
    """directions: (trees, levels, dims); cuts: (trees, 2^top - 1), medians of the nodes of the first ``top`` levels, in level order;
    deep: (trees, levels - top, 2^top), those of the levels below, by ancestor."""

    directions: np.ndarray
    cuts: np.ndarray
    deep: np.ndarray
    top: int

    def project(self, x: np.ndarray, tree: int) -> np.ndarray:
        return x @ self.directions[tree].T

    def cut(self, tree: int, level: int, node: np.ndarray) -> np.ndarray:
        if level < self.top:
            return self.cuts[tree, (1 << level) - 1 + node]
        return self.deep[tree, level - self.top, node >> (level - self.top)]

    def leaves(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): every leaf of the tree that each unit vector reaches, by row and leaf."""
        at = self.project(x, tree)
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(self.directions.shape[1]):
            away = at[row, level] - self.cut(tree, level, node)
            left, right = away <= SPILL, away > -SPILL
            row, node = np.r_[row[left], row[right]], np.r_[node[left] * 2, node[right] * 2 + 1]
        by = np.lexsort((node, row))
        return row[by], node[by]


def fit(sample: np.ndarray, total: int, dims: int, seed: int) -> Forest:
    """Trees deep enough for leaves of about LEAF of all ``total`` vectors."""
    levels = max(0, math.ceil(math.log2(max(1, total) / LEAF)))
    top = min(levels, max(0, math.floor(math.log2(max(1, len(sample)) / OWN))))
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((TREES, levels, dims))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    out = Forest(directions, np.zeros((TREES, max(1, (1 << top) - 1))), np.zeros((TREES, levels - top, 1 << top)), top)
    for tree in range(TREES):
        at = sample @ directions[tree].T
        node = np.zeros(len(sample), np.int64)
        for level in range(levels):
            into = out.cuts[tree, (1 << level) - 1 :] if level < top else out.deep[tree, level - top]
            into[: 1 << min(level, top)] = np.median(at[:, level]) if len(at) else 0.0
            by = np.argsort(node, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(node[by])) + 1) if len(by) else ():
                if len(part) >= 3:
                    into[node[part[0]]] = np.median(at[part, level])
            if level < top:
                node = node * 2 + (at[:, level] > into[node])
    return out


def matrix(col: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """A column of equally long lists as unit vectors in double precision."""
    if not rows:
        return np.zeros((0, 1))
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components would leave the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _routes(shared, tree: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(length, vectors of this length, row, leaf), some thousand vectors at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            b = whole.slice(at, 2000)
            lengths = pc.list_value_length(b.column("embedding")).to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths).tolist():
                of = np.flatnonzero(lengths == dims)
                alike = b.take(pa.array(of))
                yield dims, alike, *shared.value[dims].leaves(matrix(alike.column("embedding"), len(of)), tree)


def _sizes(shared, tree: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, _, _, leaf in _routes(shared, tree, batches):
            leaves, n = np.unique(leaf, return_counts=True)
            yield pa.record_batch([pa.array(np.full(len(n), dims), pa.int32()), pa.array(leaves), pa.array(n, pa.int64())], names=["dims", "leaf", "size"])

    return run


def _route(shared, tree: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, alike, row, leaf in _routes(shared, tree, batches):
            out = alike.select(["id", "n", "embedding"]).take(pa.array(row))
            yield pa.record_batch([pa.array(np.full(len(row), dims), pa.int32()), pa.array(leaf), *out.columns], names=["dims", "leaf", "id", "n", "embedding"])

    return run


def first_meetings(forest: Forest, x: np.ndarray, i: np.ndarray, j: np.ndarray, tree: int, leaf: int) -> np.ndarray:
    """Of pairs that meet in a leaf: those that meet in no leaf before it."""
    new = np.ones(len(i), bool)
    used, at = np.unique(np.r_[i, j], return_inverse=True)
    i, j = at[: len(i)], at[len(i) :]
    for t in range(tree + 1):
        row, node = forest.leaves(x[used], t)
        if t == tree:
            row, node = row[node < leaf], node[node < leaf]
        n = np.bincount(row, minlength=len(used))
        most = int(n.max()) if len(n) else 0
        table = np.full((len(used), max(1, most)), -1, np.int64)
        first = np.cumsum(n) - n
        table[row, np.arange(len(row)) - first[row]] = node
        live = np.flatnonzero(new)
        for part in range(0, len(live), 50_000):
            p = live[part : part + 50_000]
            a, b = table[i[p]], table[j[p]]
            new[p] = ~((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any((1, 2))
    return new


def _compare(shared, tree: int, threshold: float):
    """Rows (id, links, up): links counted here, and the least id of the component found here."""

    @tidy
    def run(key: tuple, table: pa.Table) -> pa.Table:
        dims, leaf = (k.as_py() for k in key[:2])
        ids, n, side = (table.column(c).to_numpy() for c in ("id", "n", "side"))
        x = matrix(table.column("embedding"), len(ids))
        links = np.zeros(len(ids), np.int64)
        pairs = []
        left = np.flatnonzero(side != 1)
        right = left if (side == 2).all() else np.flatnonzero(side == 1)
        for part in range(0, len(left), 512):
            rows = left[part : part + 512]
            a, b = np.nonzero(x[rows] @ x[right].T >= threshold)
            a, b = rows[a], right[b]
            if right is left:
                a, b = a[a < b], b[a < b]
            if not len(a):
                continue
            new = first_meetings(shared.value[dims], x, a, b, tree, leaf)
            links += np.bincount(a[new], n[b[new]], len(ids)).astype(np.int64) + np.bincount(b[new], n[a[new]], len(ids)).astype(np.int64)
            pairs.append(spanning(np.arange(len(ids)), a, b))
        up = ids.copy()
        if pairs:
            edges = np.concatenate(pairs)
            edges = spanning(ids, edges[:, 0], edges[:, 1])
            by_id = np.argsort(ids, kind="stable")
            up[by_id[np.searchsorted(ids[by_id], edges[:, 0])]] = edges[:, 1]
        some = (links > 0) | (up != ids)
        return pa.table({"id": pa.array(ids[some]), "links": pa.array(links[some]), "up": pa.array(up[some])})

    return run


def _usable(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0))


def _tree_links(equal: DataFrame, grown, tree: int, threshold: float) -> DataFrame:
    """(id, links, up) from the leaves of one tree, saved."""
    kind = dict(equal.dtypes)["embedding"]
    sizes = equal.mapInArrow(_sizes(grown, tree), "dims int, leaf long, size long").groupBy("dims", "leaf").agg(F.sum("size").alias("size"))
    large = sizes.where(f"size > {BLOCK}").select("dims", "leaf", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    routed = equal.mapInArrow(_route(grown, tree), f"dims int, leaf long, id long, n long, embedding {kind}")
    dealt = routed.join(large, ["dims", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side")
    dealt = dealt.select("dims", "leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "n", "embedding", side)
    return saved(dealt.groupBy("dims", "leaf", "low", "high").applyInArrow(_compare(grown, tree, threshold), "id long, links long, up long"), "forest-found")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector (see the module)."""
    spark = embeddings.sparkSession
    kind = "float" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "double"
    typed = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).where("vec_id IS NOT NULL")
    typed = typed.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    usable = _usable(typed).withColumn("embedding", F.transform("embedding", lambda v: (v + F.lit(0.0)).cast(kind)))  # -0.0 is 0.0
    equal = saved(usable.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), "forest-equal")
    totals = {r.dims: r["count"] for r in equal.groupBy(F.size("embedding").alias("dims")).count().collect()}  # a row for each length
    if not totals:
        return typed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = bounded_sample(equal.select("id", "embedding"), "id", SAMPLE, seed).toArrow()["embedding"].combine_chunks()
    lengths = pc.list_value_length(sample).to_numpy(zero_copy_only=False)
    forests = {}
    for dims, total in totals.items():
        of = np.flatnonzero(lengths == dims)
        forests[dims] = fit(matrix(sample.take(pa.array(of)), len(of)) if len(of) else np.zeros((0, dims)), total, dims, seed)
    grown = spark.sparkContext.broadcast(forests)  # for each length and tree 2^top numbers (2^top < SAMPLE / OWN) for each level
    parts = [_tree_links(equal, grown, tree, threshold) for tree in range(TREES)]
    found = saved(reduce(DataFrame.unionByName, parts), "forest-links")
    for part in parts:
        discard(part)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    of = components(found.select(F.col("id").alias("a"), F.col("up").alias("b")))
    classes = saved(equal.join(counts, "id", "left").join(of, "id", "left").select("id", "embedding", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component")), "forest-classes")
    discard(found)
    discard(equal)
    members = usable.join(classes, "embedding").select("vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"), "component")
    out = typed.select("vec_id").join(members, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"))
