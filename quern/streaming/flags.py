"""Streaming forms of the batch checks, beyond what a batch run needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def health_by_hour(stream: DataFrame, time: str = "txn_timestamp", late: str = "1 hour") -> DataFrame:
    """Counts and the share of near-duplicates by channel and hour; rows later than `late` are dropped."""
    hours = stream.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("hour"), "channel")
    return hours.agg(F.count("*").alias("n"), F.avg(F.col("is_near_duplicate").cast("double")).alias("near_share"))


def drop_repeats(stream: DataFrame, keys: list[str], time: str = "txn_timestamp", within: str = "2 minutes") -> DataFrame:
    """The first row of each key within a span of event time, by state that expires."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)
