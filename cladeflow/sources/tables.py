"""Reading wide tables of series: files or text, sorted into long series and information about them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import genotype_number, number_in
from ..operators import trees
from ..operators.packing import numbered
from . import workbook

TIME = re.compile(r"^\D?(\d+)$")


def separator(path: str) -> str:
    return "\t" if path.lower().endswith((".tsv", ".tab")) else ","


def read_wide(spark: SparkSession, path: str, encoding: str = "UTF-8", sheet: str | None = None) -> DataFrame:
    """A csv, tsv or tab file with a header, or a sheet of an .xlsx workbook; all columns as text. The older .xls form is refused."""
    if path.lower().endswith(".xls"):
        raise ValueError("the .xls form is not read here; save the workbook as .xlsx")
    if path.lower().endswith(".xlsx"):
        wide = workbook.read(spark, path, sheet)
        return wide.toDF(*[c.strip() for c in wide.columns])
    wide = spark.read.option("encoding", encoding).csv(path, header=True, sep=separator(path))
    return wide.toDF(*[c.strip() for c in wide.columns])


def text_wide(spark: SparkSession, text: str) -> DataFrame:
    """A table pasted as text: blank lines dropped, tabs or else commas between fields."""
    lines = [x.strip() for x in text.strip().splitlines() if x.strip()]
    sep = "\t" if "\t" in lines[0] else ","
    head, *rows = ([f.strip() for f in x.split(sep)] for x in lines)
    return spark.createDataFrame([tuple((r + [None] * len(head))[: len(head)]) for r in rows], ", ".join(f"`{h}` string" for h in head))


def read_any(spark: SparkSession, source: str, sheet: str | None = None) -> DataFrame:
    """A table from a path (sheet: of a workbook) or, where there is a line end in it, from pasted text."""
    return text_wide(spark, source) if "\n" in source.strip() else read_wide(spark, source, sheet=sheet)


def time_columns(columns: list[str]) -> dict[str, int]:
    """Columns named by a time: digits, with one character before them at most."""
    return {c: int(m[1]) for c in columns if (m := TIME.match(c.strip()))}


def correct_scale(long: DataFrame) -> DataFrame:
    """Each time of a population as frequencies: in [0, 1] as it is; over 2 at most, percent; else clamped to [0, 1]."""
    w = Window.partitionBy("population", "t")
    low, high = F.min("freq").over(w), F.max("freq").over(w)
    value = F.when((low >= 0) & (high <= 1), F.col("freq")).when(high > 2, F.col("freq") / 100).otherwise(F.least(F.greatest("freq", F.lit(0.0)), F.lit(1.0)))
    return long.withColumn("freq", value)


def drop_empty(long: DataFrame) -> DataFrame:
    """Without the labels whose points are all 0."""
    some = long.groupBy("population", "label").agg(F.bool_or(F.coalesce("freq", F.lit(0.0)) != 0).alias("some")).where("some")
    return long.join(some.select("population", "label"), ["population", "label"], "left_semi")


def with_time_zero(long: DataFrame) -> DataFrame:
    """Each label has a point at time 0, of 0 where none was sampled; null points are 0."""
    zeros = long.select("population", "label").distinct().select("population", "label", F.lit(0).alias("t"), F.lit(0.0).alias("zero"))
    rows = long.join(zeros, ["population", "label", "t"], "full")
    return rows.select("population", "label", "t", F.coalesce("freq", "zero", F.lit(0.0)).alias("freq"))


def parse_series(wide: DataFrame, key: str = "Trajectory", population: str = "all", keep_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """(long, info): the series of a wide table, repaired and complete, and its other columns, with names in lower case.

    The key column is numbered 1, 2, ... in file order where the table has none."""
    times = time_columns(wide.columns)
    if not times:
        raise ValueError("no column is named by a time")
    if key not in wide.columns:
        wide = numbered(wide, key).withColumn(key, F.concat(F.lit("genotype-" if key == "Genotype" else ""), F.col(key).cast("string")))
    pop = F.coalesce(F.col("Population").cast("string"), F.lit(population)) if "Population" in wide.columns else F.lit(population)
    base = wide.withColumns({"__population": pop, "__label": F.col(key).cast("string")})
    long = base.select("__population", "__label", *[number_in(F.col(f"`{c}`").cast("string")).alias(f"t{t}") for c, t in times.items()])
    long = long.unpivot(["__population", "__label"], [f"t{t}" for t in times.values()], "name", "freq")
    long = long.select(F.col("__population").alias("population"), F.col("__label").alias("label"), F.substring("name", 2, 20).cast("int").alias("t"), "freq")
    if not keep_empty:
        long = drop_empty(long)
    long = with_time_zero(correct_scale(long.withColumn("freq", F.coalesce("freq", F.lit(0.0)))))
    rest = [c for c in wide.columns if c not in times and c not in (key, "Population") and c.lower() != "genotype"]
    info = base.select(F.col("__population").alias("population"), F.col("__label").alias("label"), *[F.col(f"`{c}`").alias(c.lower()) for c in rest])
    return long, info


def parse_genotypes(wide: DataFrame, population: str = "all") -> tuple[DataFrame, DataFrame]:
    """As parse_series, with labels genotype-<i> by order of number where the first one is not so named already."""
    key = next((c for c in ("Genotype", "_c0", "Unnamed: 0", "Trajectory") if c in wide.columns), "Genotype")
    long, info = parse_series(wide, key, population)
    names = long.select("population", "label").distinct()
    w = Window.partitionBy("population").orderBy(genotype_number(F.col("label")).asc_nulls_last(), "label")
    first = F.first("label").over(w)
    named = names.withColumn("name", F.when(first.startswith("genotype-"), F.col("label")).otherwise(F.concat(F.lit("genotype-"), F.row_number().over(w).cast("string"))))
    swap = lambda d: d.join(named, ["population", "label"]).withColumn("label", F.col("name")).drop("name")
    return swap(long), swap(info)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): the first two tab-separated fields of each line; of a repeated key the last line counts."""
    lines = spark.read.text(path).withColumn("i", F.monotonically_increasing_id()).withColumn("f", F.split(F.trim("value"), "\t"))
    return lines.where(F.size("f") >= 2).groupBy(F.trim(F.col("f")[0]).alias("key")).agg(F.max_by(F.trim(F.col("f")[1]), "i").alias("value"))


def read_known_genotypes(spark: SparkSession, path: str, population: str = "all") -> DataFrame:
    """(population, genotype, label): one genotype a line, its labels between commas."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("i", F.monotonically_increasing_id())
    return lines.select(F.lit(population).alias("population"), F.concat(F.lit("known-"), F.col("i").cast("string")).alias("genotype"), F.explode(F.transform(F.split("value", ","), F.trim)).alias("label"))


def read_distances(spark: SparkSession, path: str, population: str = "all") -> DataFrame:
    """Pairs from a three-column file (label, label, distance) or a square matrix with labels in its first column."""
    wide = spark.read.csv(path, header=True, sep=separator(path))
    if len(wide.columns) == 3:
        wide = spark.read.csv(path, sep=separator(path)).toDF("a", "b", "distance")
        rows = wide.select("a", "b", F.col("distance").cast("double").alias("distance"))
    else:
        key, *labels = wide.columns
        rows = wide.unpivot([key], labels, "b", "distance").select(F.col(key).alias("a"), "b", F.col("distance").cast("double").alias("distance"))
    return rows.where("a <> b").select(F.lit(population).alias("population"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").distinct()


def read_edges(spark: SparkSession, path: str, population: str = "all") -> DataFrame:
    wide = read_wide(spark, path)
    names = {c.lower(): c for c in wide.columns}
    if not {"identity", "parent"} <= names.keys():
        raise ValueError("an edges table has the columns Identity and Parent")
    return wide.select(F.lit(population).alias("population"), F.col(names["identity"]).alias("identity"), F.col(names["parent"]).alias("parent"))


def validate_edges(edges: DataFrame) -> DataFrame:
    """``edges`` as they are, or ValueError: columns are there, each genotype has one parent, and following parents comes to an end."""
    if missing := {"population", "identity", "parent"} - set(edges.columns):
        raise ValueError(f"edges lack {sorted(missing)}")
    if not edges.groupBy("population", "identity").count().where("count > 1").limit(1).isEmpty():
        raise ValueError("a genotype has two parents")
    trees.highest(edges)
    return edges


def validate_series(long: DataFrame) -> DataFrame:
    """``long`` as it is, or ValueError: columns are there, no point is missing or stands twice, and frequencies are in [0, 1]."""
    if missing := {"population", "label", "t", "freq"} - set(long.columns):
        raise ValueError(f"the series lack {sorted(missing)}")
    if not long.where("label IS NULL OR t IS NULL OR freq IS NULL OR freq < 0 OR freq > 1").limit(1).isEmpty():
        raise ValueError("a point has no label, time or frequency in [0, 1]")
    if not long.groupBy("population", "label", "t").count().where("count > 1").limit(1).isEmpty():
        raise ValueError("a label has two points at one time")
    return long


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
