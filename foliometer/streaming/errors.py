"""The error log kept up to date from a stream of error events."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.errors import collapse_errors, merge_errors
from ..schemas import SCHEMAS
from ..session import scratch
from .runner import KeptTable, KeyedLog, start_batches


def keep_error_log(events: DataFrame, folder: str, every: str | None = None) -> KeptTable:
    """Start a query that keeps the error log in ``folder`` current.

    A micro-batch is collapsed to one row per fingerprint first and merged with the
    rows of these fingerprints only.
    """
    names = SCHEMAS["error_logs"].fieldNames()
    log = KeyedLog(events.sparkSession, f"{folder}/log", SCHEMAS["error_logs"], ["fingerprint"])

    def merge(batch: DataFrame, number: int) -> None:
        fresh = collapse_errors(batch).select(*names).persist()
        try:
            known = log.read(before=number, touched=fresh).select(*names)
            log.write(merge_errors(known, fresh).select(*names), number)
        finally:
            fresh.unpersist()

    return KeptTable(start_batches(events, merge, folder, every=every), log)


def error_stream(events: DataFrame, folder: str | None = None) -> DataFrame:
    """Error log after all available events."""
    table = keep_error_log(events, folder or scratch(events.sparkSession, "errors"))
    table.query.awaitTermination()
    return table.rows()
