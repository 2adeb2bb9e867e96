"""Walks over ancestry trees: (population, identity, parent), roots being children of genotype-0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ROOT
from ..plans.settle import settled
from .packing import numbered

P = "population"


def doubled(jumps: DataFrame, found: DataFrame, step, nodes: int) -> DataFrame:
    """``found`` after ``step(jumps, found)``, with jumps (population, identity, far) of twice the length each time, until no jump is left: as many
    rounds as the depth of the tree has binary digits. ValueError where a path is longer than the tree has nodes: a cycle."""
    for _ in range(nodes.bit_length() + 1):
        found = settled(step(jumps, found))
        over = jumps.select(P, F.col("identity").alias("far"), F.col("far").alias("next"))
        jumps = settled(jumps.join(over, [P, "far"]).select(P, "identity", F.col("next").alias("far")))
        if jumps.isEmpty():
            return found
    raise ValueError("following parents does not come to an end: the edges have a cycle")


def _parents(edges: DataFrame) -> DataFrame:
    return edges.select(P, "identity", F.col("parent").alias("far"))


def ancestors(edges: DataFrame) -> DataFrame:
    """(population, identity, ancestor, distance) of every node up to the root: a row for each node and each level above it."""
    length = [1]

    def longer(jumps: DataFrame, found: DataFrame) -> DataFrame:
        further = jumps.join(found.withColumnRenamed("identity", "far"), [P, "far"])
        out = found.unionByName(further.select(P, "identity", "ancestor", (F.col("distance") + length[0]).alias("distance")))
        length[0] *= 2
        return out

    edges = settled(edges)
    return doubled(_parents(edges), edges.select(P, "identity", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), longer, edges.count())


def highest(edges: DataFrame) -> DataFrame:
    """(population, identity, top, iterations): the highest node under the root (or under a node without a parent) at or above each node, and the node's depth, from 1.

    One row a node in each round; ValueError where the edges have a cycle."""
    edges = settled(edges)
    inner = edges.join(edges.select(P, F.col("identity").alias("parent")), [P, "parent"], "left_semi")
    start = edges.select(P, "identity", F.col("identity").alias("top"), F.lit(1).alias("iterations"))

    def step(jumps: DataFrame, found: DataFrame) -> DataFrame:
        above = found.select(P, F.col("identity").alias("far"), F.col("top").alias("over"), F.col("iterations").alias("more"))
        rows = found.join(jumps, [P, "identity"], "left").join(above, [P, "far"], "left")
        return rows.select(P, "identity", F.coalesce("over", "top").alias("top"), (F.col("iterations") + F.coalesce("more", F.lit(0))).alias("iterations"))

    return doubled(_parents(inner), start, step, edges.count())


def descendants(edges: DataFrame) -> DataFrame:
    """(population, identity, descendant): everything below each node that has something below."""
    return ancestors(edges).select("population", F.col("ancestor").alias("identity"), F.col("identity").alias("descendant"))


def clades(edges: DataFrame) -> DataFrame:
    """(population, identity, parent, clade, iterations): the child of the root above (or at) each node, and the depth, from 1."""
    return edges.join(highest(edges), [P, "identity"]).select(P, "identity", "parent", F.col("top").alias("clade"), "iterations")


def major_clades(edges: DataFrame, share: int = 20) -> DataFrame:
    """(population, identity, major): the nearest node at or above with more children than a ``share``-th of all nodes, else itself."""
    n = edges.groupBy("population").agg(F.floor(F.count(F.lit(1)) / share).alias("few"))
    major = edges.groupBy("population", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children")).join(n, "population").where("children > few").select("population", "node")
    own = edges.select("population", "identity", F.col("identity").alias("ancestor"), F.lit(0).alias("distance"))
    near = own.unionByName(ancestors(edges)).join(major.withColumnRenamed("node", "ancestor"), ["population", "ancestor"]).groupBy("population", "identity").agg(F.min_by("ancestor", "distance").alias("major"))
    return edges.select("population", "identity").join(near, ["population", "identity"], "left").select("population", "identity", F.coalesce("major", "identity").alias("major"))


def children(edges: DataFrame) -> DataFrame:
    return edges.groupBy("population", "parent").agg(F.array_sort(F.collect_list("identity")).alias("children"))


def shared_tokens(annotations: DataFrame) -> DataFrame:
    """(population, a, b, n): pairs of nodes whose annotations (array) share words, and how many; grouped by word, not over all pairs."""
    words = annotations.select("population", "identity", F.explode(F.filter(F.split(F.concat_ws(" ", "annotations"), " "), lambda w: w != "")).alias("word")).distinct()
    x, y = words.withColumnRenamed("identity", "a"), words.withColumnRenamed("identity", "b")
    return x.join(y, ["population", "word"]).where("a <= b").groupBy("population", "a", "b").agg(F.count(F.lit(1)).alias("n"))


#: rows of words that are broadcast, at most
FEW_WORDS = 100_000


def group_clades(annotations: DataFrame) -> DataFrame:
    """(population, opener, identity): greedy groups of clades. In the order of ``place`` each clade that is in no group yet opens one, with all clades
    that share a word with it, also those of other groups; a clade without words opens none. annotations: (population, identity, place, annotations), a row a clade.

    Openers share no word, so they are found in rounds of local minima: a clade opens a group once it is the first of all that hold any of its words and are
    undecided; the words of an opener are then taken, and clades that hold one are decided. Words and clades are grouped, never paired. Tables of a row a word are
    broadcast when small, so that clades don't meet by a frequent word in one task, and clades meet in a set number of tasks, which adaptive execution leaves as they are."""
    spark = annotations.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    by_clade = lambda df: df.repartition(tasks, P, "identity")
    few = lambda df: F.broadcast(df) if df.limit(FEW_WORDS + 1).count() <= FEW_WORDS else df
    held = lambda df: df.select(P, "identity", "place", F.size("words").alias("size"), F.explode("words").alias("word"))

    words = F.array_distinct(F.filter(F.split(F.concat_ws(" ", "annotations"), " "), lambda w: w != ""))
    noted = settled(annotations.select(P, "identity", "place", words.alias("words")).where(F.size("words") > 0))
    left, opened = noted, []
    while True:
        least = settled(held(left).groupBy(P, "word").agg(F.min("place").alias("place")))  # of numbers alone: a hash aggregate, no sort of all words
        likely = held(left.join(few(least.select(P, "place").distinct()), [P, "place"], "left_semi"))
        near = settled(likely.join(few(least), [P, "word", "place"]))
        first = near.groupBy(P, "word").agg(F.min("identity").alias("identity"))
        sure = near.join(first, [P, "word", "identity"]).groupBy(P, "identity", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size").select(P, "identity")
        taken = settled(near.join(sure, [P, "identity"]).select(P, "word", F.col("identity").alias("opener")))
        if taken.isEmpty():
            break
        opened.append(taken)
        decided = by_clade(held(left).join(few(taken), [P, "word"], "left_semi").select(P, "identity"))
        left = settled(by_clade(left).join(decided, [P, "identity"], "left_anti"))
    if not opened:
        return noted.select(P, F.col("identity").alias("opener"), "identity").limit(0)
    met = held(noted).join(few(reduce(DataFrame.unionByName, opened)), [P, "word"]).select(P, "opener", "identity")
    return by_clade(met).distinct()


def tour(edges: DataFrame, ages: DataFrame) -> DataFrame:
    """(population, group_id, identity, ord): every node twice, around its children, which go by descending age from the outside.

    ages: (population, identity, age). A node's path is its ancestors' ages; it opens after its closing in descending order of paths."""
    edges = settled(edges)
    start = ages.select(P, "identity", F.col("identity").alias("top"), F.lpad(F.col("age").cast("string"), 9, "0").alias("path"))

    def step(jumps: DataFrame, found: DataFrame) -> DataFrame:
        above = found.select(P, F.col("identity").alias("far"), F.col("top").alias("over"), F.col("path").alias("before"))
        rows = found.join(jumps, [P, "identity"], "left").join(above, [P, "far"], "left")
        return rows.select(P, "identity", F.coalesce("over", "top").alias("top"), F.concat_ws("/", "before", "path").alias("path"))

    paths = doubled(_parents(edges), start, step, edges.count()).where(F.col("top") == ROOT)
    keys = paths.select(P, "identity", F.col("path").alias("k"), F.concat("identity", F.lit("a")).alias("group_id")).unionByName(paths.select(P, "identity", F.concat("path", F.lit("~")).alias("k"), F.col("identity").alias("group_id")))
    placed = settled(numbered(keys.orderBy(P, F.desc("k")), "place"))
    first = placed.groupBy(P).agg(F.min("place").alias("least"))
    return placed.join(first, P).select(P, "group_id", "identity", (F.col("place") - F.col("least") + 1).cast("int").alias("ord"))
