"""Usage as it arrives: a stream of cumulative captures, rolled up by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.rollup import WINDOW_HOURS


def captures(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def usage_by_window(events: DataFrame, late: str = "1 day", hours: int = WINDOW_HOURS) -> DataFrame:
    """(window_start, event_type, n, value) of a stream (event_id, ts, event_type, value): each event counts once,
    however often it is delivered within the time for late ones, and a window is given out when that is over."""
    seen = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    totals = seen.groupBy(F.window("ts", f"{hours} hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return totals.select(F.col("w.start").alias("window_start"), "event_type", "n", "value")
