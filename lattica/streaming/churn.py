"""Churn as commits come in: touches counted per file and window, late ones up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_churn(touches: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, file, churn of a stream (or table) of touches (ts, file)."""
    counted = touches.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "file").agg(F.count(F.lit(1)).alias("churn"))
    return counted.select(F.col("w.start").alias("start"), "file", "churn")
