"""Job states kept up to date from a stream of job events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lifecycle import FINISHING, job_states
from ..session import scratch
from .runner import KeptTable, KeyedLog, start_batches

EVENT_COLUMNS = ("job_id", "kind", "ts", "seq", "progress", "error_code")
_BEGINNING = "0001-01-01 00:00:00"


def state_as_events(states: DataFrame) -> DataFrame:
    """Events that lead to the given states, dated before every real event."""
    expired = F.col("status") == "expired"
    reached = F.when(expired, F.col("before_expiry")).otherwise(F.col("status"))
    finished = reached.isin(*FINISHING)

    def step(kind, progress=None, error_code=None):
        return F.struct(
            kind.alias("kind"),
            F.lit(progress).cast("int").alias("progress"),
            F.lit(error_code).cast("string").alias("error_code"),
        )

    arrival = step(reached, None, F.col("error_code"))
    steps = F.array(
        F.when(~finished, arrival),
        step(F.lit("progress"), F.col("progress")),
        F.when(finished, arrival),
        F.when(expired, step(F.lit("expire"))),
    )
    return states.select("job_id", F.posexplode(F.array_compact(steps)).alias("seq", "e")).select(
        "job_id",
        "e.kind",
        F.lit(_BEGINNING).cast("timestamp").alias("ts"),
        F.col("seq").cast("long").alias("seq"),
        "e.progress",
        "e.error_code",
    )


def keep_states(events: DataFrame, folder: str, every: str | None = None) -> KeptTable:
    """Start a query that keeps the state of every job in ``folder`` current.

    The states before a micro-batch enter it as events of their own, so the batch
    operator serves here as well. Events must not arrive after later ones of an
    earlier batch.
    """
    job_id = events.schema["job_id"]
    schema = T.StructType(
        [job_id]
        + [T.StructField(name, T.StringType()) for name in ("status", "error_code")]
        + [T.StructField("progress", T.IntegerType())]
        + [T.StructField("before_expiry", T.StringType())]
    )
    log = KeyedLog(events.sparkSession, f"{folder}/log", schema, ["job_id"])

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.select(*EVENT_COLUMNS).persist()
        try:
            known = log.read(before=number, touched=batch)
            log.write(job_states(state_as_events(known).unionByName(batch), True), number)
        finally:
            batch.unpersist()

    return KeptTable(start_batches(events, merge, folder, every=every), log)


def lifecycle_stream(events: DataFrame, folder: str | None = None) -> DataFrame:
    """State of every job after all available events."""
    table = keep_states(events, folder or scratch(events.sparkSession, "lifecycle"))
    table.query.awaitTermination()
    return table.rows().select("job_id", "status", "progress", "error_code")
