"""Bars and running variances from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str, lateness: str, series: str = "event_type", price: str = "value") -> DataFrame:
    """Tumbling bars of a stream with ts, an order within it (event_id), a series and a price.

    A bar leaves in append mode once the watermark has passed its end, so the bar that still forms is never
    seen; later ticks are dropped by the watermark. The same expressions give the same bars on a batch.
    """
    at = F.struct("ts", "event_id")
    windowed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).filter(F.col(price) > 0)
    return (
        windowed.groupBy(F.col(series).alias("series_id"), F.window("ts", width).alias("w"))
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
        .select("series_id", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )
