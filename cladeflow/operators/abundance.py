"""Abundances of genotypes through time, and the stacked-area table drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import DETECTED, ROOT, VISIBLE
from .packing import placed
from .trees import tour

P = "population"


def subtract_children(long: DataFrame, edges: DataFrame, dlimit: float = DETECTED, visible: float = VISIBLE) -> DataFrame:
    """Parents lose their greatest child's frequency at each time, so that the child can be drawn on them; what remains under ``dlimit``
    shows as ``visible``, and undetected points are 0. Other genotypes stay; those without an edge go."""
    kept = long.join(edges.select(P, F.col("identity").alias("label")), [P, "label"], "left_semi")
    below = long.join(edges.select(P, F.col("identity").alias("label"), "parent"), [P, "label"]).groupBy(P, F.col("parent").alias("label"), "t").agg(F.max("freq").alias("child"))
    parents = edges.select(P, F.col("parent").alias("label")).distinct().withColumn("is_parent", F.lit(True))
    rows = kept.join(parents, [P, "label"], "left").join(below, [P, "label", "t"], "left")
    rest = F.col("freq") - F.coalesce("child", F.lit(0.0))
    reduced = F.when(F.col("freq") <= dlimit, 0.0).when(rest < dlimit, visible).otherwise(rest)
    return rows.select(P, "label", "t", F.when(F.col("is_parent"), reduced).otherwise(F.col("freq")).alias("freq"))


def population_table(long: DataFrame, edges: DataFrame, dlimit: float = DETECTED, adjust: bool = True) -> DataFrame:
    """(population, generation, identity, abundance): percent of each genotype at each time, what is left being the root's."""
    rows = subtract_children(long, edges, dlimit) if adjust else long.join(edges.select(P, F.col("identity").alias("label")), [P, "label"], "left_semi")
    own = rows.select(P, F.col("t").alias("generation"), F.col("label").alias("identity"), (F.col("freq") * 100).alias("abundance"))
    return own.unionByName(ancestral(own))


def ancestral(own: DataFrame) -> DataFrame:
    return own.groupBy(P, "generation").agg(F.greatest(F.lit(0.0), 100 - F.sum("abundance")).alias("abundance")).select(P, "generation", F.lit(ROOT).alias("identity"), "abundance")


def wide(table: DataFrame) -> DataFrame:
    """(population, identity, series): abundances as shares in the order of generations; a sink format."""
    return table.groupBy(P, "identity").agg(F.transform(F.array_sort(F.collect_list(F.struct("generation", "abundance"))), lambda x: x["abundance"] / 100).alias("series"))


def start_points(table: DataFrame) -> DataFrame:
    """Points half way before each generation in which a genotype first shows: for each genotype the mean of the two
    generations around, 0 for those that start there. None where all start together."""
    gens = table.select(P, "generation").distinct().withColumn("before", F.coalesce(F.lag("generation").over(Window.partitionBy(P).orderBy("generation")), F.lit(0)))
    first = table.where("abundance > 0").groupBy(P, "identity").agg(F.min("generation").alias("start")).where("start <> 0")
    several = first.groupBy(P).agg(F.countDistinct("start").alias("n")).where("n > 1").select(P)
    starts = first.select(P, F.col("start").alias("generation")).distinct().join(several, P, "left_semi").join(gens, [P, "generation"])
    now = table.join(starts, [P, "generation"])
    then = table.select(P, F.col("generation").alias("before"), "identity", F.col("abundance").alias("earlier"))
    rows = now.join(then, [P, "before", "identity"], "left").join(first, [P, "identity"], "left")
    mid = (F.col("generation") + F.col("before")) / 2
    mean = (F.col("abundance") + F.coalesce("earlier", F.lit(0.0))) / 2
    return rows.select(P, mid.cast("double").alias("generation"), "identity", F.when(F.col("start") == F.col("generation"), 0.0).otherwise(mean).alias("abundance"))


def semi_frequencies(rows: DataFrame) -> DataFrame:
    """Half of each abundance and of its share of the generation's sum (0 of 0)."""
    whole = F.sum("abundance").over(Window.partitionBy(P, "generation"))
    share = F.when(whole > 0, F.col("abundance") / whole * 0.5).otherwise(0.0)
    return rows.select(P, "generation", "identity", (F.col("abundance") / 2).alias("abundance"), share.alias("frequency"))


def ages(table: DataFrame) -> DataFrame:
    """(population, identity, age): place by first generation shown (the last one for those never shown), then by name."""
    last = F.max("generation").over(Window.partitionBy(P))
    seen = table.withColumn("last", last).where("abundance > 0 OR generation = last").groupBy(P, "identity").agg(F.min("generation").alias("first"))
    return placed(seen, ["first"], ["identity"], "age").select(P, "identity", "age")


def stacked_area(table: DataFrame, edges: DataFrame) -> DataFrame:
    """(population, generation, identity, abundance, frequency, group_id, unique_id, ord): each genotype as two halves around its children."""
    whole = table.select(P, F.col("generation").cast("double").alias("generation"), "identity", "abundance")
    halves = semi_frequencies(whole.unionByName(start_points(table)))
    order = tour(edges, ages(table))
    rows = halves.join(order, [P, "identity"])
    gen = F.when(F.col("generation") == F.floor("generation"), F.col("generation").cast("long").cast("string")).otherwise(F.col("generation").cast("string"))
    out = rows.withColumn("unique_id", F.concat_ws("_", "group_id", gen))
    return placed(out.withColumnRenamed("ord", "turn"), ["generation"], ["turn"], "ord").select(P, "generation", "identity", "abundance", "frequency", "group_id", "unique_id", "ord")


def merge_halves(stacked: DataFrame) -> DataFrame:
    """Halves that follow each other in the stack (genotypes without children between) become one series."""
    groups = stacked.groupBy(P, "group_id", "identity").agg(F.min("ord").alias("place"))
    after = F.lead("group_id").over(Window.partitionBy(P).orderBy("place"))
    before = F.lag("group_id").over(Window.partitionBy(P).orderBy("place"))
    joined = groups.withColumn("target", F.when(before == F.expr("substring(group_id, 1, length(group_id) - 1)"), before).otherwise(F.col("group_id"))).withColumn("merged", (after == F.concat("group_id", F.lit("a"))) | (F.col("target") != F.col("group_id")))
    rows = stacked.join(joined.select(P, "group_id", "target", "merged"), [P, "group_id"])
    return rows.groupBy(P, "generation", "identity", F.col("target").alias("group_id")).agg(F.sum("abundance").alias("abundance"), F.sum("frequency").alias("frequency"), F.min("ord").alias("ord"))


def label_anchors(merged: DataFrame) -> DataFrame:
    """(population, group_id, x, y): where to write a series' name: x half the span of its generations shown (else the first one), y its
    frequency there on top of the series before it."""
    shown = merged.where("abundance <> 0")
    span = shown.groupBy(P, "group_id").agg(((F.max("generation") - F.min("generation")) / 2).alias("mid"), F.min("generation").alias("first"), F.collect_set("generation").alias("gens"))
    at = span.select(P, "group_id", F.when(F.array_contains("gens", F.col("mid")), F.col("mid")).otherwise(F.col("first")).alias("x"))
    place = merged.groupBy(P, "group_id").agg(F.min("ord").alias("place"))
    heap = merged.join(place, [P, "group_id"]).withColumn("under", F.sum("frequency").over(Window.partitionBy(P, "generation").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return at.join(heap.select(P, "group_id", F.col("generation").alias("x"), F.col("under").alias("y")), [P, "group_id", "x"])


def label_places(anchors: DataFrame, near_x: float = 2.0, near_y: float = 0.1, top: float | None = None) -> DataFrame:
    """(population, group_id, x, y, moved): anchors of which no two are nearer than ``near_x`` in x and ``near_y`` in y at once.

    x goes to the middle of its band of near_x. In a band labels keep their order by (y, group_id), and each goes up as far as the one under it asks for, those
    with room stay; with ``top``, what would stand higher goes down again, as far as the labels over it ask for. The rows of a band are ordered alone, and the same
    anchors always give the same places."""
    band = F.floor(F.col("x") / near_x)
    w = Window.partitionBy(P, "band").orderBy("y", "group_id")
    rows = anchors.withColumn("band", band).withColumn("i", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(P, "band")))
    up = F.col("i") * near_y + F.max(F.col("y") - F.col("i") * near_y).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = up if top is None else F.least(up, F.lit(float(top)) - (F.col("n") - F.col("i")) * near_y)
    x = (F.col("band") + 0.5) * near_x
    return rows.withColumn("place", place).select(P, "group_id", x.alias("x"), F.col("place").alias("y"), ((x != F.col("x")) | (F.abs(F.col("place") - F.col("y")) > 1e-12)).alias("moved"))


def interpolated(long: DataFrame, points: int = 100) -> DataFrame:
    """(population, label, i, x, y): each series at ``points`` even steps from its first time up to, not including, its last, on straight lines."""
    w = Window.partitionBy(P, "label")
    ahead = F.lead(F.struct("t", "freq")).over(w.orderBy("t"))
    rows = long.withColumn("next", ahead).withColumn("lo", F.min("t").over(w)).withColumn("hi", F.max("t").over(w)).where("next IS NOT NULL")
    step = (F.col("hi") - F.col("lo")) / points
    from_i, to_i = F.ceil((F.col("t") - F.col("lo")) / step - 1e-9), F.ceil((F.col("next.t") - F.col("lo")) / step - 1e-9) - 1
    rows = rows.withColumn("i", F.explode(F.when(to_i >= from_i, F.sequence(from_i.cast("int"), F.least(to_i, F.lit(points - 1)).cast("int"))).otherwise(F.array().cast("array<int>"))))
    x = F.col("lo") + step * F.col("i")
    return rows.select(P, "label", "i", x.alias("x"), (F.col("freq") + (x - F.col("t")) / (F.col("next.t") - F.col("t")) * (F.col("next.freq") - F.col("freq"))).alias("y"))


def lineage_shares(long: DataFrame, lineages: DataFrame, flimit: float = 0.97) -> DataFrame:
    """(population, t, total, ancestor): summed lineage maxima at each time, and what is left for the ancestor before they sum to the limit."""
    tops = long.join(lineages, [P, "label"]).groupBy(P, "lineage", "t").agg(F.max("freq").alias("freq"))
    sums = tops.groupBy(P, "t").agg(F.sum("freq").alias("total"))
    end = sums.groupBy(P).agg(F.coalesce(F.min(F.when(F.col("total") >= flimit, F.col("t"))), F.max("t")).alias("end"))
    return sums.join(end, P).select(P, "t", "total", F.when(F.col("t") < F.col("end"), 1 - F.col("total")).otherwise(0.0).alias("ancestor"), (F.col("t") >= F.col("end")).alias("settled"))


def lineage_score(shares: DataFrame) -> DataFrame:
    """(population, score): mean square of the totals once they have reached the limit."""
    return shares.where("settled").groupBy(P).agg(F.avg(F.col("total") * F.col("total")).alias("score"))
