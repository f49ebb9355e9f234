"""Requests per client and minute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runner import KeptTable, drain_updates, keep_updates

STATE_DELAY = "90 seconds"
WINDOW_KEYS = ["bucket", "client_ip", "minute"]


def request_windows(requests: DataFrame, delay: str = STATE_DELAY) -> DataFrame:
    """Streaming count of requests per bucket, client and minute.

    Counts are combined per task before the shuffle. State is dropped ninety seconds
    after the window, as far as the watermark knows; later requests are not counted.
    """
    return (
        requests.withWatermark("ts", delay)
        .groupBy(
            "bucket",
            F.coalesce("client_ip", F.lit("unknown")).alias("client_ip"),
            F.window("ts", "1 minute").alias("w"),
        )
        .agg(F.count("*").alias("requests"))
        .select(
            "bucket",
            "client_ip",
            F.floor(F.unix_seconds("w.start") / 60).alias("minute"),
            "requests",
        )
    )


def with_rejections(windows: DataFrame, limit: int) -> DataFrame:
    """Windows with the number of requests over the limit."""
    over = F.greatest(F.lit(0), F.col("requests") - limit) if limit > 0 else F.lit(0)
    return windows.withColumn("rejected", over.cast("long"))


def keep_windows(
    requests: DataFrame, folder: str, delay: str = STATE_DELAY, every: str | None = None
) -> KeptTable:
    """Start a query that keeps the counts per window in ``folder`` current."""
    return keep_updates(request_windows(requests, delay), WINDOW_KEYS, folder, every)


def offender_stream(requests: DataFrame, limit: int, delay: str = STATE_DELAY) -> DataFrame:
    """Windows of one minute with the number of requests and of rejected ones."""
    windows = drain_updates(request_windows(requests, delay), WINDOW_KEYS, "limits")
    return with_rejections(windows, limit)
