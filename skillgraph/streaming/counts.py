"""Skill profile counts kept over a stream of interactions, for logs that arrive continuously."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_skill_counts(interactions: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, skill_id, n_interactions, n_correct) of a streaming frame with epoch seconds; rows later than ``late`` are dropped."""
    timed = interactions.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", window).alias("window"), "skill_id")
    return counts.agg(F.count("*").alias("n_interactions"), F.sum("correct").alias("n_correct"))
