"""Job progress events as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .event_source import FORMAT, register

EVENT = "id string, status string, progress int, error_code string"


def encode_events(jobs: DataFrame) -> DataFrame:
    """Progress messages of jobs, one channel per job; absent fields are written as null."""
    payload = F.struct(
        F.col("id").cast("string").alias("id"),
        "status",
        F.col("progress").cast("int").alias("progress"),
        "error_code",
    )
    return jobs.select(
        F.concat(F.lit("job-events:"), F.col("id").cast("string")).alias("channel"),
        F.to_json(payload, {"ignoreNullFields": "false"}).alias("value"),
    )


def decode_events(messages: DataFrame) -> DataFrame:
    """Progress messages as columns; unreadable ones have no id."""
    return messages.select("channel", F.from_json("value", EVENT).alias("e")).select(
        "channel", "e.*"
    )


def publish_events(jobs: DataFrame, folder: str, writer: str = "main") -> None:
    """Append the progress messages of jobs to a folder of events."""
    register(jobs.sparkSession)
    messages = encode_events(jobs)
    messages.write.format(FORMAT).option("writer", writer).mode("append").save(folder)


def publish_event_stream(jobs: DataFrame, folder: str, checkpoint: str, writer: str = "main", every: str | None = None):
    """Start appending the progress messages of a stream of jobs to a folder of events."""
    register(jobs.sparkSession)
    sink = encode_events(jobs).writeStream.format(FORMAT).option("path", folder).option("writer", writer)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return sink.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """All events of a folder as columns."""
    register(spark)
    return decode_events(spark.read.format(FORMAT).load(folder))


def read_event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events as they arrive in a folder."""
    register(spark)
    return decode_events(spark.readStream.format(FORMAT).load(folder))
