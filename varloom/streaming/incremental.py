"""Incremental variant statistics over a stream of calls: the mergeable part of the variant ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_statistics(calls: DataFrame, key: tuple[str, ...] = ("chrom", "pos", "gene"), score: str = "score") -> DataFrame:
    """Mean, max and count by variant, in update or complete mode; medians are not mergeable and stay in batch."""
    return calls.groupBy(*key).agg(F.avg(score).alias("mean_score"), F.max(score).alias("max_score"), F.count(score).alias("num_samples"))


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 hour", *keys: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
