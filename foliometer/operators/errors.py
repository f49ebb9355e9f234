"""The error log, one row per fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import error_fingerprint, truncate


def collapse_errors(events: DataFrame) -> DataFrame:
    """Error events reduced to one row per fingerprint.

    Count and last sighting accumulate, the message is the latest one; path, stack
    and creation time stay those of the first event. A plain aggregation: partial
    results are merged before and after the shuffle.
    """
    message = truncate(F.concat_ws(": ", "exc_type", "message"), C.ERROR_MESSAGE_LENGTH)
    when = F.struct("ts", "id")
    return (
        events.select(
            error_fingerprint("exc_type", "file", "function").alias("fingerprint"),
            message.alias("message"),
            "path",
            truncate("stack", C.ERROR_STACK_LENGTH).alias("stack"),
            "ts",
            "id",
        )
        .groupBy("fingerprint")
        .agg(
            F.count("*").alias("count"),
            F.max_by("message", when).alias("message"),
            F.min_by(F.struct("path", "stack"), when).alias("__first"),
            F.min("ts").alias("created_at"),
            F.max("ts").alias("last_seen_at"),
        )
        .select(
            "fingerprint",
            F.lit("error").alias("level"),
            "message",
            F.lit("api").alias("service"),
            "__first.path",
            "__first.stack",
            "count",
            F.lit(False).alias("resolved"),
            "created_at",
            "last_seen_at",
        )
    )


def merge_errors(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Error log after newly collapsed errors: a repeated error is open again."""
    old = existing.withColumn("__new", F.lit(0))
    new = fresh.withColumn("__new", F.lit(1))
    first = F.min_by(F.struct("level", "service", "path", "stack", "created_at"), "__new")
    last = F.max_by(F.struct("message", "resolved", "last_seen_at"), "__new")
    return (
        old.unionByName(new)
        .groupBy("fingerprint")
        .agg(F.sum("count").alias("count"), first.alias("f"), last.alias("l"))
        .select(
            "fingerprint",
            "f.level",
            "l.message",
            "f.service",
            "f.path",
            "f.stack",
            "count",
            "l.resolved",
            "f.created_at",
            "l.last_seen_at",
        )
    )


def set_resolved(errors: DataFrame, ids: DataFrame, resolved: bool = True) -> DataFrame:
    """Mark the listed fingerprints as resolved or open."""
    listed = ids.select("fingerprint").distinct().withColumn("__hit", F.lit(True))
    flag = F.when(F.col("__hit"), F.lit(resolved)).otherwise(F.col("resolved"))
    return (
        errors.join(listed, "fingerprint", "left").withColumn("resolved", flag).drop("__hit")
    )


def clear_resolved(errors: DataFrame) -> DataFrame:
    """The log without resolved errors."""
    return errors.filter(~F.col("resolved"))
