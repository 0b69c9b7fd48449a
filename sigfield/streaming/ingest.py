"""Streaming extension: consolidated bins of readings as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_bins(readings: DataFrame, cell: float, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Strongest signal and count per band, grid bin and time window of a stream with ``ts``."""
    at = lambda c: F.floor(F.col(c) / cell + 0.5).alias(f"b{c}")
    return readings.withWatermark("ts", late).groupBy(F.window("ts", window), "band", at("x"), at("y")).agg(F.max("rssi").alias("rssi"), F.count(F.lit(1)).alias("n"))
