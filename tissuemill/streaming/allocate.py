"""Incremental allocation: a stream of points joined to a static mask and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.points import points_in_mask


def allocate_stream(points: DataFrame, mask: DataFrame, watermark: tuple[str, str] | None = None, window: str | None = None) -> DataFrame:
    """Counts per (instance, gene), and per window of the event time where ``watermark`` (column, delay) and ``window`` are given; start in update mode, or append with a watermark."""
    rows = points if watermark is None else points.withWatermark(*watermark)
    found = points_in_mask(rows, mask)
    keys = ["instance", "gene"] + ([F.window(watermark[0], window).alias("window")] if watermark and window else [])
    return found.groupBy(*keys).agg(F.count("*").alias("count"))
