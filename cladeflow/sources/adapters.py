"""Star-schema and event tables as frequency series, so that every operator runs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def scaled(cells: DataFrame) -> DataFrame:
    """Values over the largest of all, to six digits."""
    top = cells.agg(F.max("value").alias("top"))  # one row
    return cells.crossJoin(F.broadcast(top)).select(F.lit("all").alias("population"), "label", "t", F.round(F.col("value") / F.col("top"), 6).alias("freq"))


def over_all_times(cells: DataFrame) -> DataFrame:
    """Every label at every time from 0 (or the first one, if that is earlier) to the last."""
    span = cells.agg(F.least(F.min("t"), F.lit(0)).alias("first"), F.max("t").alias("last"))  # one row
    grid = cells.select("population", "label").distinct().crossJoin(F.broadcast(span)).select("population", "label", F.explode(F.sequence("first", "last")).alias("t"))
    return grid.join(cells, ["population", "label", "t"], "left").select("population", "label", "t", F.coalesce("freq", F.lit(0.0)).alias("freq"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of users: purchases of each three days from the start of 2024 (or the first purchase, if that is earlier) to the last one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'")
    t = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 3).cast("int")
    cells = events.groupBy(F.col("user_id").cast("string").alias("label"), t.alias("t")).agg(F.round(F.sum("value"), 4).alias("value"))
    return over_all_times(scaled(cells))


def supplier_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of suppliers: quantity shipped each year from 1995 (or the first year, if that is earlier) to the last one, over the largest."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cells = lines.groupBy(F.col("l_suppkey").cast("string").alias("label"), (F.year("l_shipdate") - 1995).alias("t")).agg(F.sum("l_quantity").alias("value"))
    return over_all_times(scaled(cells))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed series of embeddings of any length, mapped from [-1, 1] to [0, 1]; empty ones and null ones are no series."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.lit("all").alias("population"), F.col("vec_id").cast("string").alias("label"), F.transform("embedding", lambda x: (x.cast("double") + 1) / 2).alias("fs")).where("size(fs) > 0")


def customer_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges region - nation - segment of a nation - customer; regions are children of the root."""
    region, nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer"))
    tops = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("identity"), F.lit("genotype-0").alias("parent"))
    mids = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("identity"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    segments = customer.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(":"), F.col("c_mktsegment")).alias("identity"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent")).distinct()
    own = customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("identity"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(":"), F.col("c_mktsegment")).alias("parent"))
    return tops.unionByName(mids).unionByName(segments).unionByName(own).select(F.lit("all").alias("population"), "identity", "parent")
