"""Live activity over a trailing quarter of an hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .runner import KeptTable, drain_updates, keep_updates


def activity_windows(jobs: DataFrame, slide: str = "1 minute") -> DataFrame:
    """Jobs per trailing window: all, and those processing or queued.

    The same expression serves batches and streams.
    """
    span = F.window("created_at", f"{C.LIVE_WINDOW_MINUTES} minutes", slide)
    return (
        jobs.groupBy(span.alias("w"))
        .agg(
            F.count("*").alias("recent_jobs"),
            F.count_if(F.col("status").isin("processing", "queued")).alias("active_jobs"),
        )
        .select(F.col("w.end").alias("window_end"), "recent_jobs", "active_jobs")
    )


def keep_activity(
    jobs: DataFrame, folder: str, delay: str = "1 minute", every: str | None = None
) -> KeptTable:
    """Start a query that keeps the activity per window in ``folder`` current."""
    counted = activity_windows(jobs.withWatermark("created_at", delay))
    return keep_updates(counted, ["window_end"], folder, every)


def activity_stream(jobs: DataFrame, delay: str = "1 minute") -> DataFrame:
    """W5 over a stream, the last value of every window."""
    counted = activity_windows(jobs.withWatermark("created_at", delay))
    return drain_updates(counted, ["window_end"], "activity")
