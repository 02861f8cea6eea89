"""Bars of a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(ticks: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """asset, start, open, high, low, close, volume (the number of ticks) of a stream (asset, ts, value): a bar is given
    out once no tick can reach it any more, `late` after its end in event time."""
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy("asset", F.window("ts", length).alias("w")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume")
    )
    return grouped.select("asset", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")
