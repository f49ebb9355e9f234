"""Visits as they arrive."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.measures import trend_bucket
from ..operators.enrich import classify_visits
from ..session import scratch
from ..sources.visits import split_visits
from .runner import KeptTable, drain_updates, keep_updates, start

# Visits that cannot be a visitor's first are spread over so many groups.
SPREAD = 4096
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_routes(visits: DataFrame) -> DataFrame:
    """Visits with ``route``: by visitor for the earliest of each visitor in an Arrow batch.

    Only these can be a visitor's first visit. The others are spread evenly, so a visitor
    with any number of visits sends one row per Arrow batch to the task that holds the state.
    """
    schema = T.StructType([*visits.schema.fields, T.StructField("route", T.StringType())])

    def route(batches):
        for batch in batches:
            order = pc.sort_indices(pa.table(batch.select(["created_at", "id"])), [("created_at", "ascending"), ("id", "ascending")])
            visitors = batch.column("visitor_id").take(order).to_numpy(zero_copy_only=False).astype(str)
            _, firsts = np.unique(visitors, return_index=True)
            first = np.zeros(batch.num_rows, bool)
            first[order.to_numpy()[firsts]] = True
            names = batch.column("visitor_id").to_pylist()
            spread = [f"rest {zlib.crc32(str(one).encode()) % SPREAD}" for one in batch.column("id").to_pylist()]
            routes = [f"visitor {name}" if own else other for name, own, other in zip(names, first, spread, strict=True)]
            yield batch.append_column("route", pa.array(routes, pa.string()))

    return visits.mapInArrow(route, schema)


class FirstSeen(StatefulProcessor):
    """One value per visitor in the state store: that it has been seen."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        first = None
        known = key[0].startswith("rest ") or self.seen.exists()
        for frame in rows:
            frame = frame.drop(columns="route").assign(is_returning=True)
            if not known:
                held = frame if first is None else pd.concat([first, frame])
                held = held.sort_values(["created_at", "id"])
                first, frame = held.iloc[:1], held.iloc[1:]
            yield frame
        if first is not None:
            self.seen.update((True,))
            yield first.assign(is_returning=False)

    def close(self) -> None:
        pass


def flagged_visits(visits: DataFrame) -> DataFrame:
    """A stream of visits with ``is_returning``: false for a visitor's first visit alone.

    Whether a visitor has been seen is kept in Spark's state store, so a micro-batch reads
    its own rows and the state of its own visitors. Arrival order decides between
    micro-batches, event time within one.
    """
    schema = T.StructType([*visits.schema.fields, T.StructField("is_returning", T.BooleanType())])
    return with_routes(visits).groupBy("route").transformWithStateInPandas(
        statefulProcessor=FirstSeen(), outputStructType=schema, outputMode="Append", timeMode="None"
    )


def start_visits(
    raw_stream: DataFrame, folder: str, every: str | None = None
) -> tuple[StreamingQuery, StreamingQuery]:
    """Start appending flagged visits to ``folder``/rows and rejected rows to ``folder``/quarantine.

    Both sinks take every micro-batch once. Started again over the same folder, the queries
    go on from their checkpoints and the state kept there.
    """
    spark = raw_stream.sparkSession
    valid, rejected = split_visits(raw_stream)
    known = spark.conf.get(STATE_STORE, None)
    # A query keeps the settings it was started with.
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        writer = flagged_visits(classify_visits(valid)).writeStream.format("parquet")
        rows = start(writer.option("path", f"{folder}/rows"), f"{folder}/checkpoint-rows", every)
    finally:
        if known is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, known)
    writer = rejected.writeStream.format("parquet").option("path", f"{folder}/quarantine")
    return rows, start(writer, f"{folder}/checkpoint-quarantine", every)


def ingest_visits(raw_stream: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Enriched visits and rejected rows of all that a raw stream has to offer."""
    spark = raw_stream.sparkSession
    folder = folder or scratch(spark, "visits")
    for query in start_visits(raw_stream, folder):
        query.awaitTermination()
    visits = classify_visits(raw_stream).schema
    flagged = T.StructType([*visits.fields, T.StructField("is_returning", T.BooleanType())])
    rows = spark.read.schema(flagged).parquet(f"{folder}/rows")
    return rows, spark.read.schema(raw_stream.schema).parquet(f"{folder}/quarantine")


def daily_visitors(visits: DataFrame, delay: str, approx: bool) -> tuple[DataFrame, list[str]]:
    """Streaming (day, visitor_id, views), or with ``approx`` (day, sketch), and its keys."""
    days = F.window("created_at", "1 day")
    timed = visits.withWatermark("created_at", delay)
    day = F.col("window.start").alias("day")
    if approx:
        sketches = timed.groupBy(days).agg(F.hll_sketch_agg("visitor_id").alias("sketch"))
        return sketches.select(day, "sketch"), ["day"]
    pairs = timed.groupBy(days, "visitor_id").agg(F.count("*").alias("views"))
    return pairs.select(day, "visitor_id", "views"), ["day", "visitor_id"]


def trend_of(daily: DataFrame, group_by: str, approx: bool) -> DataFrame:
    """Distinct visitors per bucket from the table of days."""
    bucket = trend_bucket("day", group_by).alias("bucket")
    if approx:
        estimate = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
        return daily.groupBy(bucket).agg(estimate.alias("v"))
    seen = daily.filter(F.col("visitor_id").isNotNull()).select(bucket, "visitor_id").distinct()
    return seen.groupBy("bucket").agg(F.count("*").alias("v"))


def keep_days(
    visits: DataFrame, folder: str, delay: str = "1 hour", approx: bool = False, every: str | None = None
) -> KeptTable:
    """Start a query that keeps the table of days in ``folder`` current; read it with ``trend_of``."""
    return keep_updates(*daily_visitors(visits, delay, approx), folder, every)


def trend_stream(
    visits: DataFrame, group_by: str = "daily", delay: str = "1 hour", approx: bool = False
) -> DataFrame:
    """Distinct visitors per day, week, month or year, kept up to date.

    State is kept per day: one row per visitor, or with ``approx`` one sketch. Days that
    the watermark has passed leave the state, and visits later than that are not counted.
    Days are put together into buckets when the result is read.
    """
    daily = drain_updates(*daily_visitors(visits, delay, approx), "trend")
    return trend_of(daily, group_by, approx)
