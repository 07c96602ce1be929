"""Dereplication of a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedbed.functions.sequences import unaligned


def first_seen(stream: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """Records whose bases, gaps aside, weren't seen within the watermark: the first of each is passed on.

    State holds a hash of the bases for as long as late records may come, so it is bounded by the delay."""
    keyed = stream.withColumn("_key", F.sha2(unaligned(F.col("bases")), 256)).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "30 days", delay: str = "1 day") -> DataFrame:
    """Records of each key in tumbling windows; late ones count until the watermark has passed."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
