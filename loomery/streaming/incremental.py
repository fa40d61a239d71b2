"""Batch operators kept up to date over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_prevalence(events: DataFrame, time: str, category: str, sample: str, width: str, delay: str) -> DataFrame:
    """Approximate distinct samples by window and category; late rows beyond the delay are left out."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), F.col(category)).agg(F.approx_count_distinct(sample).alias("n_samples"), F.count("*").alias("n_rows"))


def running_counts(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("n"))
