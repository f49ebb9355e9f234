"""Status of jobs from their event history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.measures import clamp_progress
from .folds import ordered_fold
from .skew import attach

FINISHING = ("completed", "failed", "cancelled")


def _when_at(condition):
    return F.when(condition, F.struct("ts", "seq"))


def job_states(events: DataFrame, keep_stage: bool = False) -> DataFrame:
    """Final state of each job.

    ``events(job_id, kind, ts, seq, progress, error_code)`` with kinds pending, queued,
    processing, progress, completed, failed, cancelled, retry and expire. A finished
    job accepts only ``retry``, which reopens it, and ``expire``. Only the part after
    the last retry decides, and within it the first finishing event; both are found by
    aggregation, so no history is folded in one task. ``keep_stage`` adds the status an
    expired job had before (``before_expiry``).
    """
    kind = F.col("kind")
    retries = events.groupBy("job_id").agg(
        F.max(_when_at(kind == "retry")).alias("reopened"), F.count("*").alias("rows")
    )
    counts = retries.select("job_id", "rows")
    current = attach(events, retries.drop("rows"), ["job_id"], ["ts", "seq"], counts).filter(
        F.col("reopened").isNull() | (F.struct("ts", "seq") >= F.col("reopened"))
    )
    finishes = current.groupBy("job_id").agg(
        F.min(_when_at(kind.isin(*FINISHING))).alias("finished")
    )
    after = F.struct("ts", "seq") > F.col("finished")
    accepted = F.coalesce(~after, F.lit(True)) & (kind != "expire")
    stage = F.when(kind == "retry", "queued").otherwise(kind)
    advance = accepted & (kind != "progress")
    sets_progress = accepted & kind.isin("progress", "processing", "retry", "completed")
    progress = (
        F.when(kind == "completed", 100)
        .when(kind == "progress", clamp_progress("progress"))
        .otherwise(0)
    )
    place = F.struct("ts", "seq")
    return (
        attach(current, finishes, ["job_id"], ["ts", "seq"], counts)
        .groupBy("job_id")
        .agg(
            F.max_by(stage, F.when(advance, place)).alias("stage"),
            F.max_by(progress, F.when(sets_progress, place)).alias("progress"),
            F.max_by("error_code", F.when(advance, place)).alias("error_code"),
            F.bool_or(after & (kind == "expire")).alias("expired"),
        )
        .select(
            "job_id",
            F.when(F.coalesce("expired", F.lit(False)), "expired")
            .otherwise(F.coalesce("stage", F.lit("pending")))
            .alias("status"),
            F.coalesce("progress", F.lit(0)).alias("progress"),
            F.when(F.col("stage") == "failed", F.col("error_code")).alias("error_code"),
            *([F.coalesce("stage", F.lit("pending")).alias("before_expiry")] * keep_stage),
        )
    )


def event_feed(events: DataFrame, cap: int = C.EVENT_FEED_CAP) -> DataFrame:
    """What a watcher of a job receives: its events up to the finishing one, 600 at most.

    The rank filter is applied per task before the shuffle, so a chatty job costs no
    more than ``cap`` rows per task.
    """
    order = W.partitionBy("job_id").orderBy("ts", "seq")
    first = events.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)
    # Over at most ``cap`` rows per job, which the ranks have brought together already.
    so_far = order.rowsBetween(W.unboundedPreceding, -1)
    ended = F.bool_or(F.col("kind").isin(*FINISHING)).over(so_far)
    return first.withColumn("__ended", ended).filter(~F.coalesce("__ended", F.lit(False))).drop("__ended")


STATE = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("progress", T.IntegerType()),
        T.StructField("error_code", T.StringType()),
    ]
)


def _advance(state: tuple, columns: dict[str, list]) -> tuple:
    """(stage, progress, error code, expired) after some more events of a job."""
    stage, progress, code, expired = state
    events = zip(columns["kind"], columns["progress"], columns["error_code"], strict=True)
    for kind, reported, error in events:
        if kind == "retry":
            stage, progress, code, expired = "queued", 0, error, False
        elif stage in FINISHING:
            expired = expired or kind == "expire"
        elif kind == "progress":
            if reported is not None:
                progress = max(0, min(100, reported))
        elif kind != "expire":
            stage, code = kind, error
            progress = {"processing": 0, "completed": 100}.get(kind, progress)
    return stage, progress, code, expired


def _reached(key: tuple, state: tuple):
    stage, progress, code, expired = state
    yield (*key, "expired" if expired else stage, progress, code if stage == "failed" else None)


def folded_states(events: DataFrame) -> DataFrame:
    """Final state of each job, by an ordered fold over its events; see ``job_states``.

    Events go by ``ts`` and ``seq``. A history of any length is folded piece by piece. The
    aggregation is the better plan where one job holds a large part of all events, since an
    ordered fold of one job takes place in one task.
    """
    schema = T.StructType([events.schema["job_id"], *STATE.fields])
    rows = events.select("job_id", "ts", "seq", "kind", F.col("progress").cast("int").alias("progress"), "error_code")
    return ordered_fold(
        rows, ["job_id"], ["ts", "seq"], schema,
        lambda key: ("pending", 0, None, False), _advance, _reached,
    )
