"""When a series first passes a limit, and which series pass the trajectory and genotype filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DETECTED

KEY = ["population", "label"]


def _first_above(limit) -> Column:
    return F.min(F.when(F.col("freq") > limit, F.col("t")))


def first_above(long: DataFrame, limit: float) -> DataFrame:
    """First time above ``limit``; the first time of all where there is none."""
    return long.groupBy(*KEY).agg(F.coalesce(_first_above(limit), F.min("t")).alias("t"))


def first_detected(long: DataFrame, limit: float = DETECTED) -> DataFrame:
    """As first_above, without labels whose time 0 only stands for "never"."""
    rows = long.groupBy(*KEY).agg(F.coalesce(_first_above(limit), F.min("t")).alias("t"), F.min_by("freq", "t").alias("initial"))
    return rows.where((F.col("t") != 0) | (F.col("initial") > limit)).select(*KEY, "t")


def first_significant(long: DataFrame, limit: float = 0.15) -> DataFrame:
    """First time above ``limit``; the last time of all where there is none."""
    return long.groupBy(*KEY).agg(F.coalesce(_first_above(limit), F.max("t")).alias("t"))


def first_fixed(long: DataFrame, limit: float) -> DataFrame:
    """As first_above, without time 0 (unless the limit is 0)."""
    rows = first_above(long, limit)
    return rows if limit == 0 else rows.where("t <> 0")


def boundaries_fixed(long: DataFrame, limit: float) -> DataFrame:
    """First and last time above ``limit``, of the labels that have one."""
    return long.where(F.col("freq") > limit).groupBy(*KEY).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def dynamics(long: DataFrame, dlimit: float, flimit: float) -> DataFrame:
    """Kinds of points of each label: fixed (>= flimit), intermediate (closed interval), undetected; immediate: never in between."""
    fixed, between, none = F.col("freq").between(flimit, 2), F.col("freq").between(dlimit, flimit), F.col("freq").between(-2, dlimit)
    return long.groupBy(*KEY).agg(
        F.count_if(fixed).alias("n_fixed"), F.count_if(between).alias("n_intermediate"), F.count_if(none).alias("n_undetected"),
        (F.count_if(F.col("freq") <= dlimit) + F.count_if(F.col("freq") >= flimit) == F.count(F.lit(1))).alias("immediate"),
        F.bool_and((F.col("freq") > flimit) | (F.col("freq") < dlimit)).alias("only_fixed"),
    )


def trajectory_reasons(long: DataFrame, dlimit: float = DETECTED, flimit: float = 0.97, consistency: float = 0.1, single: bool = True, startfixed: bool = True) -> DataFrame:
    """The first filter that a label fails, or "passed"."""
    rows = long.groupBy(*KEY).agg(F.count_if(F.col("freq") > dlimit).alias("seen"), F.min_by("freq", "t").alias("initial"), (F.max("freq") - F.min("freq")).alias("range"))
    reason = F.when(F.lit(single) & (F.col("seen") < 2), "onlyDetectedOnce").when(F.lit(startfixed) & (F.col("initial") > flimit), "startedFixed")
    return rows.select(*KEY, reason.when(F.lit(consistency > 0) & (F.col("range") <= consistency), "isConstant").otherwise("passed").alias("reason"))


def filter_trajectories(long: DataFrame, **limits) -> DataFrame:
    """The points of the labels that pass."""
    return long.join(trajectory_reasons(long, **limits).where("reason = 'passed'").select(*KEY), KEY, "left_semi")


def fuzzy_backgrounds(long: DataFrame, frequencies: list[float]) -> DataFrame:
    """(population, label, cutoff): labels whose maximum passes the highest of ``frequencies`` that any label passes."""
    tops = long.groupBy(*KEY).agg(F.max("freq").alias("top"))
    limits = F.array(*[F.lit(float(f)) for f in frequencies])
    passed = F.array_max(F.filter(limits, lambda f: F.max("top").over(Window.partitionBy("population")) > f))
    return tops.withColumn("cutoff", passed).where("cutoff IS NOT NULL AND top > cutoff").select(*KEY, "cutoff")


def background_times(long: DataFrame, backgrounds: DataFrame, dlimit: float) -> DataFrame:
    """(population, background, seen_t, fixed_t, fixed_freq): a background's time of detection or fixation is that of its least value above the limit (the first of equal ones)."""
    at = lambda limit: F.min(F.when(F.col("freq") > limit, F.struct("freq", "t")))
    points = long.join(backgrounds, KEY).groupBy(*KEY).agg(at(F.lit(dlimit)).alias("seen"), at(F.col("cutoff")).alias("fixed"))
    return points.select("population", F.col("label").alias("background"), F.col("seen.t").alias("seen_t"), F.col("fixed.t").alias("fixed_t"), F.col("fixed.freq").alias("fixed_freq"))


def leading(times: DataFrame) -> DataFrame:
    """Of backgrounds with the same two times only those whose frequency when fixed exceeds that of all before them by name: what a later one of the others rules
    out, an earlier one does."""
    before = Window.partitionBy("population", "fixed_t", "seen_t").orderBy("background").rowsBetween(Window.unboundedPreceding, -1)
    return times.withColumn("most", F.max("fixed_freq").over(before)).where("most IS NULL OR fixed_freq > most").drop("most")


def invalid_genotypes(long: DataFrame, frequencies: list[float], dlimit: float = DETECTED, strict: bool = False) -> DataFrame:
    """(population, label, background, reason): genotypes that cannot be as they are beside a background, once each, with the first such background by name.

    A genotype meets the sampled times inside its span, and at each the leading backgrounds fixed then: an equi-join on the time, which can split, in
    place of all backgrounds beside each genotype."""
    backgrounds = fuzzy_backgrounds(long, frequencies)
    times = background_times(long, backgrounds, dlimit)
    others = long.join(backgrounds.select(*KEY), KEY, "left_anti")
    seen = F.when(F.col("freq") > dlimit, F.col("t"))
    spans = others.groupBy(*KEY).agg(F.count(seen).alias("n"), F.min(seen).alias("first"), F.max(seen).alias("last"))
    fixed = times.select("population", F.col("fixed_t").alias("t")).distinct()  # the sampled times at most
    inside = spans.where("n >= 2").join(fixed, "population").where("first < t AND t < last").join(others.select(*KEY, "t", "freq"), [*KEY, "t"], "left").withColumn("freq", F.coalesce("freq", F.lit(0.0)))
    if not strict:
        inside = inside.where(F.col("freq") > dlimit)
    met = inside.join(leading(times).withColumnRenamed("fixed_t", "t"), ["population", "t"]).where("first < seen_t AND seen_t < last")
    if not strict:
        met = met.where(F.col("freq") + F.col("fixed_freq") > 1 + dlimit)
    present = met.groupBy(*KEY).agg(F.min("background").alias("background")).withColumn("reason", F.lit("presentBeforeAndAfterFixedGenotype"))
    few = spans.where("n < 2").select(*KEY).join(times.groupBy("population").agg(F.min("background").alias("background")), "population").withColumn("reason", F.lit("notEnoughTimepoints"))
    return present.unionByName(few)


def first_invalid(long: DataFrame, ranks: DataFrame, frequencies: list[float], dlimit: float = DETECTED, strict: bool = False) -> DataFrame:
    """(population, label): of each population the invalid genotype that is found first, backgrounds going by rank and genotypes by rank beside each."""
    place = F.lpad(F.col("rank").cast("string"), 10, "0")
    named = ranks.select(*KEY, place.alias("place"))
    found = invalid_genotypes(long.join(named, KEY).drop("label").withColumnRenamed("place", "label"), frequencies, dlimit, strict)
    first = found.groupBy("population").agg(F.min(F.struct("background", "label")).alias("m")).select("population", F.col("m.label").alias("place"))
    return first.join(named, ["population", "place"]).select(*KEY)
