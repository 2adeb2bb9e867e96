"""Long and packed forms, and pairs of labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.settle import settled
from .blocks import Block, ends, once, over_blocks, tiles


def pack(long: DataFrame) -> DataFrame:
    """(population, label, fs): one row a label; a label's points are few (the sampled times)."""
    rows = long.groupBy("population", "label").agg(F.array_sort(F.collect_list(F.struct("t", "freq"))).alias("points"))
    return rows.select("population", "label", F.transform("points", lambda p: p["freq"]).alias("fs"))


def unpack(packed: DataFrame, times: list[int]) -> DataFrame:
    at = F.posexplode(F.arrays_zip(F.array(*map(F.lit, times)).alias("t"), F.col("fs").alias("freq"))).alias("i", "p")
    return packed.select("population", "label", at).select("population", "label", F.col("p.t").alias("t"), F.col("p.freq").alias("freq"))


def complete(long: DataFrame, times: list[int]) -> DataFrame:
    """Every label at every time of ``times``; missing points are 0."""
    grid = long.select("population", "label").distinct().withColumn("t", F.explode(F.array(*map(F.lit, times))))
    return grid.join(long, ["population", "label", "t"], "left").select("population", "label", "t", F.coalesce("freq", F.lit(0.0)).alias("freq"))


#: rows of a population in a block, about: a task joins some pairs of blocks
BLOCK = 256


def pairs(rows: DataFrame, order: str = "label", block: int = BLOCK) -> DataFrame:
    """Each unordered pair of rows of a population once: (population, a, b), structs of the rows, a before b in ``order``.

    Rows are dealt by hash to blocks of about ``block`` rows and meet in pairs of blocks: an equi-join on the pair of blocks, each row being
    copied once for each block of its population. The keys are dealt to a set number of tasks, which adaptive execution leaves as
    they are: rows are few and small beside the pairs that they make."""
    sizes = rows.groupBy("population").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    blocked = rows.join(sizes, "population").withColumn("mine", F.pmod(F.xxhash64(order), F.col("blocks").cast("long")).cast("int"))
    row = F.struct(*[c for c in rows.columns if c != "population"])
    dealt = blocked.select("population", "mine", row.alias("row"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = F.xxhash64("population", F.least("mine", "other"), F.greatest("mine", "other"))
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keyed = dealt.select("population", "mine", "other", "row", met.alias("met")).repartition(tasks, "met")
    left, right = keyed.alias("x"), keyed.alias("y").hint("shuffle_hash")
    # one join key, the one the rows are dealt by; the rest (a key may stand for two pairs of blocks) is put so that it makes no other keys
    blocks = (F.col("x.mine") - F.col("y.other") == 0) & (F.col("x.other") - F.col("y.mine") == 0) & F.array_contains(F.array("x.population"), F.col("y.population"))
    return left.join(right, (F.col("x.met") == F.col("y.met")) & (F.col(f"x.row.{order}") < F.col(f"y.row.{order}")) & blocks).select("x.population", F.col("x.row").alias("a"), F.col("y.row").alias("b"))


def overlaps(packed: DataFrame, dlimit: float) -> DataFrame:
    """(population, a, b, overlap) of each pair: the number of points where both are above ``dlimit``."""

    def run(x: Block, y: Block) -> Iterator[dict[str, pa.Array]]:
        sx, sy = x.series > dlimit, y.series > dlimit
        for i, j in tiles(x, y):
            (n,) = once(x, y, i, j, lambda i, j: [(sx.take(i, 1) & sy.take(j, 1)).sum(0, dtype=np.int32)])
            yield {**ends(x, y, i, j), "overlap": pa.array(n)}

    return over_blocks(packed, run, "a string, b string, overlap int", alike=True)


def placed(rows: DataFrame, groups: list[str], order: list, name: str) -> DataFrame:
    """``rows`` with their place in their population, from 1, in the order of ``groups`` (columns, none of them null) and then ``order``: places inside
    groups after the sizes of the groups before, so that no task orders a whole population."""
    key = ["population", *groups]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(*key, (F.sum("__n").over(Window.partitionBy("population").orderBy(*groups)) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__in", inside).join(before, key).withColumn(name, (F.col("__in") + F.col("__before")).cast("int")).drop("__in", "__before")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with their place in the order of the input, from 1: places inside partitions, after the sizes of the partitions before."""
    apart = settled(rows.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = apart.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return apart.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1).drop("__at", "__part", "__before")


def pair_count(n: int) -> int:
    return n * (n - 1) // 2
