"""Connected components of a graph given as a table of edges, by stars and local contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, tidy

#: edges that one task contracts (16 bytes each)
PER_TASK = 1_000_000


def spanning(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Links (x, y are places in ids) as one edge (id, least id of its component) for each linked place that is not the least."""
    by_id = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[by_id] = np.arange(len(ids))
    x, y = place[x], place[y]
    up = np.arange(len(ids))
    while len(x):  # roots hook to lesser roots, then all pointers go to roots: each round joins every root with a neighbour or is joined
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while True:
            over = up[up]
            if (over == up).all():
                break
            up = over
        x, y = up[x], up[y]
        apart = x != y
        x, y = x[apart], y[apart]
    moved = np.flatnonzero(up != np.arange(len(ids)))
    return np.stack([ids[by_id[moved]], ids[by_id[up[moved]]]], 1)


def _contract(per_task: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            edges = np.concatenate(held, 1)
            held.clear()
            ids, at = np.unique(edges, return_inverse=True)
            at = at.reshape(2, -1)
            found = spanning(ids, at[0], at[1])
            return pa.record_batch([pa.array(found[:, 1]), pa.array(found[:, 0])], names=["a", "b"])

        for b in batches:
            if b.num_rows:
                held.append(np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]))
            if sum(h.shape[1] for h in held) >= per_task:
                yield flush()
        if held:
            yield flush()

    return run


def star_round(live: DataFrame) -> DataFrame:
    """One round on edges a < b: every node's greater neighbours go to its least neighbour, then every node and its lesser neighbours do."""
    both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(live.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = saved(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "components-least")  # a table of its own: a join with it can split a hub's edges
    large = saved(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct(), "components-large")
    discard(least)
    least = saved(large.groupBy("b").agg(F.min("a").alias("m")), "components-least")
    lesser = large.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")
    small = saved(lesser.unionByName(least.select(F.col("m").alias("a"), "b")).distinct(), "components-small")
    discard(large)
    discard(least)
    return small


def _all_stars(live: DataFrame) -> bool:
    """Whether each edge goes from a centre, which is no one's member, to a member of that centre alone."""
    torn = live.groupBy("b").count().where("count > 1").select("b").unionByName(live.select(F.col("a").alias("b")).join(live.select("b"), "b", "left_semi"))
    return torn.limit(1).isEmpty()


def components(edges: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(id, component) of every end of ``edges`` (a long, b long); component is the least id reachable.

    Edges are dealt to tasks of ``per_task`` each, which put stars around least ids in place of what they hold; then two star operations
    bring neighbours of neighbours together. A chain of n nodes, its ids in any order, takes about log2(n) rounds, a star two (tests count them). Once the edges fit one task, its stars are the components. Minima aggregate on
    the map side and joins on hubs can be split, so no node's edges come together in one task. Null ends and loops are ignored. No
    edges: an empty result."""
    links = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a < b")
    live = saved(links.distinct(), "components-edges")
    while True:
        tasks = -(-live.count() // per_task)
        stars = saved(live.repartition(max(1, tasks)).mapInArrow(_contract(per_task), "a long, b long"), "components-stars")
        discard(live)
        if tasks <= 1 or _all_stars(stars):
            break
        live = star_round(stars)
        discard(stars)
    return stars.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(stars.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
