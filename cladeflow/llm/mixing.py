"""Operator 6, mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source gets a mean repetition rate so that its expected share of the output is its target weight; each
document's number of copies is the Poisson quantile, at that mean, of a uniform number hashed from the seed and
doc_id; documents are exploded by their count and dealt to all partitions by a hash of seed, doc_id and copy, the order
inside a partition being that hash too: a global shuffle that any run repeats. A source's cumulative probabilities are
summed once, in its row of the table of rates; a document looks up its number in them. The few documents of a rare source, whose mean is over LARGE, sum the
probabilities about the mean themselves (24 deviations), and their copies are made in blocks that are dealt to all partitions first.

Rows: the uniform number of a null doc_id is that of the text "null"; a null source is a source of its own, found
under the key "" of the weights (as is an empty one). Rows that share a doc_id, and those without one, draw the same number and so get equal counts: for
them the shares hold only on average over seeds. Sources without a target weight weigh
nothing and go, unless no weights are given: then all sources weigh the same. An empty table gives an empty result. All
columns are kept; one named like a column added here (copy, n_copies, rate, shuffle_key) gets underscores before its name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, partitions, saved

#: rates of up to so many sources are broadcast, with tables of this many bytes at most in all
BROADCAST_SOURCES, BROADCAST_BYTES = 50_000, 16 << 20
ADDED = ("copy", "n_copies", "rate", "shuffle_key")
LEAST = 1e-30
#: mean beyond which a document sums probabilities about the mean, and copies of a document that a task makes
LARGE, BLOCK = 1000.0, 10_000


def uniform(seed: int, *parts: Column) -> Column:
    """52 hashed bits as a number in [0, 1)."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def cumulative(mean: Column) -> Column:
    """(before, sums): P(N <= n) of N Poisson of the mean for n = before, before + 1, ... up to where the rest is under 2^-52; before it they are
    nothing beside 2^-52. Summed by the recurrence ln p(n) = ln p(n - 1) + ln(mean / n), which no mean drives out of range."""
    limit = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct((-mean).alias("log"), F.exp(-mean).alias("sum"), F.when(F.exp(-mean) > LEAST, F.array(F.exp(-mean))).otherwise(F.array().cast("array<double>")).alias("sums"), F.when(F.exp(-mean) > LEAST, 0).otherwise(1).alias("before"))

    def step(s: Column, k: Column) -> Column:
        log = s["log"] + F.ln(mean) - F.ln(k.cast("double"))
        total = s["sum"] + F.exp(log)
        shown = total > LEAST
        return F.struct(log.alias("log"), total.alias("sum"), F.when(shown, F.array_append(s["sums"], total)).otherwise(s["sums"]).alias("sums"), F.when(shown, s["before"]).otherwise(s["before"] + 1).alias("before"))

    table = F.aggregate(F.sequence(F.lit(1), limit), start, step)
    some = F.struct(table["before"].alias("before"), table["sums"].alias("sums"))
    return F.when(mean > 0, some).otherwise(F.struct(F.lit(0).alias("before"), F.array(F.lit(1.0)).alias("sums")))


def poisson_quantile(table: Column, u: Column) -> Column:
    """The least n with P(N <= n) > u, from a table of ``cumulative``."""
    return F.when(u > 0, table["before"] + F.size(F.filter(table["sums"], lambda c: c <= u))).otherwise(0)


def large_quantile(mean: Column, u: Column) -> Column:
    """The least n with P(N <= n) > u of N Poisson of a mean over LARGE, from the probabilities within 12 deviations, each by Stirling's series."""
    reach = 12 * F.sqrt(mean) + 40
    low, high = F.floor(mean - reach), F.ceil(mean + reach)

    def probability(n: Column) -> Column:
        k = n.cast("double")
        return F.exp((k - mean) + k * F.log1p((mean - k) / k) - F.ln(2 * math.pi * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, k: Column) -> Column:
        total = s["sum"] + probability(k)
        return F.struct(total.alias("sum"), (s["n"] + F.when(total <= u, 1).otherwise(0)).alias("n"))

    return F.when(u > 0, low + F.aggregate(F.sequence(low, high), start, step)["n"]).otherwise(0).cast("int")


def replicated(counted: DataFrame, most: float) -> DataFrame:
    """Rows with n_copies as their copies, numbered from 1. most: a mean that none exceeds; where it is large, blocks of copies are dealt out before they are made."""
    whole = counted.where("n_copies > 0")
    if most <= BLOCK:
        return whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    few = whole.where(F.col("n_copies") <= BLOCK).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    blocks = whole.where(F.col("n_copies") > BLOCK).withColumn("first", F.explode(F.sequence(F.lit(1), F.col("n_copies"), F.lit(BLOCK))))
    dealt = blocks.repartition(partitions(counted.sparkSession), F.xxhash64("id", "first"))
    return few.unionByName(dealt.withColumn("copy", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + (BLOCK - 1), F.col("n_copies"))))).drop("first"))


def rates(documents: DataFrame, weights: dict[str, float] | None, epochs: float) -> DataFrame:
    """(source_key, rate): the mean number of copies of a document, one row a source."""
    counts = documents.groupBy(F.coalesce("source", F.lit("")).alias("source_key")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), F.col("source_key")), F.lit(0.0)) if weights else F.lit(0.0)
    weighed = counts.withColumn("weight", weight)
    total = weighed.agg(F.sum("n").alias("total"), F.sum("weight").alias("whole"))
    return weighed.crossJoin(F.broadcast(total)).select("source_key", (F.col("total") * epochs * F.col("weight") / F.nullif(F.col("whole"), F.lit(0.0)) / F.col("n")).alias("rate"))


def mix_sources(documents: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """``documents`` replicated and shuffled; adds copy (from 1), n_copies, rate and shuffle_key.

    weights: target share of each source, in any unit (None: equal shares). epochs: expected size of the output over that of the input."""
    own = documents.columns
    names = {c: fresh(documents, f"_{c}") if c.lower() in ADDED else c for c in own}
    return _mixed(documents, weights, epochs, seed).select(*(F.col(f"doc.`{c}`").alias(names[c]) for c in own), "copy", "n_copies", "rate", "shuffle_key")


def mix_documents(documents: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """mix_sources with the columns of ``documents`` alone: copies are repeated rows."""
    return _mixed(documents, weights, epochs, seed).select("doc.*")


def _mixed(documents: DataFrame, weights: dict[str, float] | None, epochs: float, seed: int) -> DataFrame:
    """(doc, copy, n_copies, rate, shuffle_key); doc is the row."""
    tables = saved(rates(documents, weights, epochs).withColumn("table", F.when(F.coalesce("rate", F.lit(0.0)) <= LARGE, cumulative(F.least(F.coalesce("rate", F.lit(0.0)), F.lit(LARGE))))), "mixing-rates")
    docs = documents.select(F.struct(*documents.columns).alias("doc"), F.coalesce("source", F.lit("")).alias("source_key"), F.col("doc_id").alias("id"))
    sources, size, most = tables.agg(F.count(F.lit(1)), F.sum(F.octet_length("source_key") + 8 * F.coalesce(F.size("table.sums"), F.lit(0))), F.max("rate")).first()
    if sources <= BROADCAST_SOURCES and (size or 0) <= BROADCAST_BYTES:
        joined = docs.join(F.broadcast(tables), "source_key")
    else:  # a hot source is dealt over all partitions
        salts = partitions(documents.sparkSession)
        joined = docs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(tables.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["source_key", "salt"])
    counted = joined.select("doc", "id", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.when(F.col("rate") > LARGE, large_quantile(F.col("rate"), uniform(seed, F.col("id")))).otherwise(poisson_quantile(F.col("table"), uniform(seed, F.col("id")))).alias("n_copies"))
    dealt = replicated(counted, most or 0.0).withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"shuffle{seed}"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("copy").cast("string"))))
    return dealt.repartition(partitions(documents.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")
