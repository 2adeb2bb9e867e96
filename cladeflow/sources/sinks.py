"""Writing results: one folder a logical table, tab-separated with a header, or parquet."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: logical tables and their folders
TABLES = {
    "trajectories": "tables", "genotypes": "tables", "edges": "tables", "populations": "tables", "stacked": "tables",
    "distances": "supplementary-files", "distance_matrix": "supplementary-files", "linkage": "supplementary-files", "scores": "supplementary-files", "members": "supplementary-files",
    "annotations": "supplementary-files", "options": "supplementary-files", "lineage_dot": "graphics", "palette": "graphics", "trajectory_palette": "graphics", "series": "graphics", "label_anchors": "graphics", "label_places": "graphics", "smooth": "graphics", "script": "scripts",
}


def flat(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text: csv holds plain values."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])


def write_table(df: DataFrame, folder: str, name: str, fmt: str = "tsv", keep: bool = False) -> str:
    """Write a logical table; ``keep`` leaves one that is there alone. Returns its path."""
    path = f"{folder}/{TABLES[name]}/{name}"
    mode = "ignore" if keep else "overwrite"
    if fmt == "tsv":
        flat(df).write.mode(mode).csv(path, header=True, sep="\t")
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"{fmt!r} is not a format: tsv or parquet")
    return path


#: genotypes that a drawing script names colors of
DRAWN = 5000


def write_text(spark: SparkSession, text: str, folder: str, name: str) -> str:
    """Write a short text as one part of a logical table."""
    path = f"{folder}/{TABLES[name]}/{name}"
    spark.createDataFrame([(text,)], "text string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
    return path


def trajectory_table(long: DataFrame, info: DataFrame, members: DataFrame) -> DataFrame:
    """Series in the order of time, information and genotype of each label; labels of no genotype are "rejected"."""
    series = long.groupBy("population", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "freq"))), lambda x: x["freq"]).alias("series"))
    rows = series.join(info, ["population", "label"], "full").join(members, ["population", "label"], "left")
    return rows.withColumn("genotype", F.coalesce("genotype", F.lit("rejected")))


def options_json(options) -> str:
    from dataclasses import asdict

    return json.dumps(asdict(options), sort_keys=True, indent=4)


def plot_script(stacked: str, image: str, palette: dict[str, str]) -> str:
    """An R script that draws the written stacked-area table, colors in the order of sorted names."""
    colors = ", ".join(f'"{palette[k]}"' for k in sorted(palette))
    return "\n".join([
        "library(ggplot2)", f'files <- list.files("{stacked}", pattern="csv$", full.names=TRUE)', 'stacked <- do.call(rbind, lapply(files, read.table, header=TRUE, sep="\\t", comment.char=""))',
        "stacked <- stacked[order(stacked$ord), ]", "stacked$group_id <- factor(stacked$group_id, levels=unique(stacked$group_id))", f"palette <- c({colors})",
        "ggplot(stacked, aes(x=generation, y=frequency, group=group_id, fill=identity)) + geom_area() + scale_fill_manual(values=palette)", f'ggsave("{image}")',
    ])
