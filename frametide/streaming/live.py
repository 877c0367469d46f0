"""Beyond the recordings' own workflow: the per-recording range and median of a track while its frames arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_range(stream: DataFrame, time: str, key: list[str], value: str, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(key, start, lo, hi, n) of tumbling windows; rows later than `late` are dropped with their window's state."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), *key)
        .agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"))
        .select(*key, F.col("w.start").alias("start"), "lo", "hi", "n")
    )
