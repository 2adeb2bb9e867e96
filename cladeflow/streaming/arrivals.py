"""Series that arrive point by point (an extension: the batch operators on a stream).

Points come as (population, label, t, freq, at); ``at`` is when they were measured. Late points are taken within the watermark;
each micro-batch merges into the table of series, and what depends on them is computed from that table as from any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def distinct_points(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each point once, though it be sent again within the watermark."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["population", "label", "t"])


def windowed_means(stream: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(population, label, window, freq, n): mean of the points measured in each window."""
    return stream.withWatermark("at", late).groupBy("population", "label", F.window("at", every)).agg(F.avg("freq").alias("freq"), F.count(F.lit(1)).alias("n"))


def into_table(stream: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Add distinct points to a parquet table; after each micro-batch ``then`` sees the whole table.

    A batch has a folder of its own number, overwritten, so a batch that runs again after a failure leaves its points once."""

    def merge(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if then is not None:
            then(batch.sparkSession.read.schema(batch.schema).parquet(path))

    return distinct_points(stream).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
