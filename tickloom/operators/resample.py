"""Bars from ticks, and coarser bars from finer ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import duration


def resample(ticks: DataFrame, interval: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """First, highest, lowest and last price and summed volume of each bucket; empty buckets have no row.

    The order of ticks is (ts, seq); partial aggregates are merged by it, so a busy symbol needs no sort.
    """
    order = F.struct("ts", "seq")
    grouped = ticks.groupBy(*keys, F.window("ts", duration(interval)).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"),
    )
    return grouped.select(*keys, F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "volume")


def coarsen(bars: DataFrame, interval: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars of a longer interval from bars of a shorter one that divides it."""
    grouped = bars.groupBy(*keys, F.window("bar_start", duration(interval)).alias("w")).agg(
        F.min_by("open", "bar_start").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "bar_start").alias("close"), F.sum("volume").alias("volume"),
    )
    return grouped.select(*keys, F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "volume")
