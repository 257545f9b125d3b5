"""Streaming savings per session, an extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_savings(entries: DataFrame, late: str = "10 minutes", width: str = "10 minutes") -> DataFrame:
    """Tokens saved per session and time window; entries later than ``late`` are dropped."""
    saved = entries.filter("tokens_saved > 0").withWatermark("ts", late)
    return saved.groupBy(F.window("ts", width), "session").agg(F.sum("tokens_saved").alias("tokens_saved"), F.count(F.lit(1)).alias("optimizations"))
