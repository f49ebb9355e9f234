"""Traffic dashboard: visits by visitor, session, time and dimension."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.filters import between_days, dashboard_filters, dimension_filters
from ..functions.measures import growth_pct, trend_bucket, trend_label


def traffic_kpis(visits: DataFrame, params=None, now=None, approx: bool = False) -> DataFrame:
    """A2: page views, distinct visitors (all, first-time, returning), distinct sessions.

    One scan. Visitors and sessions are reduced together by (kind, key), which
    replaces four separate distinct counts.
    """
    visits = dashboard_filters(visits, params, now)
    returning = F.col("is_returning")
    if approx:
        return visits.agg(
            F.count("*").alias("page_views"),
            F.approx_count_distinct("visitor_id").alias("total_visitors"),
            F.approx_count_distinct(F.when(~returning, F.col("visitor_id"))).alias(
                "unique_visitors"
            ),
            F.approx_count_distinct(F.when(returning, F.col("visitor_id"))).alias(
                "returning_visitors"
            ),
            F.approx_count_distinct("session_id").alias("total_sessions"),
        )
    entry = F.explode(
        F.array(
            F.struct(F.lit("visitor").alias("kind"), F.col("visitor_id").alias("key")),
            F.struct(F.lit("session").alias("kind"), F.col("session_id").alias("key")),
        )
    )
    reduced = (
        visits.select(entry.alias("e"), "is_returning")
        .groupBy("e.kind", "e.key")
        .agg(
            F.count("*").alias("views"),
            F.max(~returning).alias("as_new"),
            F.max(returning).alias("as_returning"),
        )
    )
    visitor = F.col("kind") == "visitor"
    known = F.col("key").isNotNull()
    return reduced.agg(
        F.coalesce(F.sum(F.when(visitor, F.col("views"))), F.lit(0)).alias("page_views"),
        F.count_if(visitor & known).alias("total_visitors"),
        F.count_if(visitor & known & F.col("as_new")).alias("unique_visitors"),
        F.count_if(visitor & known & F.col("as_returning")).alias("returning_visitors"),
        F.count_if(~visitor & known).alias("total_sessions"),
    )


def period_comparison(visits: DataFrame, params=None, now=None) -> DataFrame:
    """A3: distinct visitors of today, 7 and 30 days against the period before.

    Ignores the selected date range and honours the other filters. One scan of
    the last sixty days: each visitor is reduced to six yes/no flags first.
    """
    today = datetime.fromisoformat(str(now)).date()
    spans = {"today": 1, "week": 7, "month": 30}

    def days(offset: int, length: int):
        last = today - timedelta(days=offset)
        return between_days("created_at", last - timedelta(days=length - 1), last)

    visits = dimension_filters(visits, params).filter(days(0, 60))
    flags = []
    for name, length in spans.items():
        flags += [
            F.max(days(0, length)).alias(f"{name}_now"),
            F.max(days(length, length)).alias(f"{name}_before"),
        ]
    totals = (
        visits.filter(F.col("visitor_id").isNotNull())
        .groupBy("visitor_id")
        .agg(*flags)
        .agg(
            *[
                F.count_if(f"{name}_{side}").alias(f"{name}_{side}")
                for name in spans
                for side in ("now", "before")
            ]
        )
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("period"),
                F.col(f"{name}_now").alias("value"),
                F.col(f"{name}_before").alias("previous"),
            )
            for name in spans
        ]
    )
    return (
        totals.select(F.explode(rows).alias("p"))
        .select("p.*")
        .withColumn("growth_pct", growth_pct(F.col("value"), F.col("previous")))
    )


def trend(rows: DataFrame, params=None, now=None) -> DataFrame:
    """Rows per day, week, month or year, with axis labels, in time order.

    With visitor type ``unique`` on visits, distinct visitors are counted instead.
    """
    params = params or {}
    unit = params.get("group_by")
    distinct = params.get("visitor_type") == "unique" and params.get("distinct", True)
    value = F.countDistinct("visitor_id") if distinct else F.count("*")
    return (
        dashboard_filters(rows, params, now)
        .groupBy(trend_bucket("created_at", unit).alias("bucket"))
        .agg(value.alias("v"))
        .select("bucket", trend_label("bucket", unit).alias("m"), "v")
        .orderBy("bucket")
    )


def job_trend(jobs: DataFrame, params=None, now=None) -> DataFrame:
    """Jobs per time bucket; always counts rows."""
    return trend(jobs, {**(params or {}), "distinct": False}, now)


def dimension_ranking(
    visits: DataFrame,
    params=None,
    now=None,
    k: int = C.RANKING_SIZE,
    dimensions=C.RANKED_DIMENSIONS,
) -> DataFrame:
    """A5: top ``k`` values of each dimension, all dimensions in one scan.

    The NULL group competes for a place and is dropped afterwards; ties go to the
    smaller name, NULL last.
    """
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("dimension"), F.col(name).alias("name"))
                for name in dimensions
            ]
        )
    )
    counts = (
        dashboard_filters(visits, params, now)
        .select(pairs.alias("d"))
        .groupBy("d.dimension", "d.name")
        .agg(F.count("*").alias("count"))
    )
    order = W.partitionBy("dimension").orderBy(F.desc("count"), F.asc_nulls_last("name"))
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .filter(F.col("name").isNotNull())
        .select("dimension", "name", "count", "rank")
    )


def top_tools(jobs: DataFrame, params=None, now=None, k: int = C.RANKING_SIZE) -> DataFrame:
    """Most used tools among the filtered jobs."""
    return tool_usage(dashboard_filters(jobs, params, now), k)


def tool_usage(jobs: DataFrame, n: int) -> DataFrame:
    """Job counts of the ``n`` most used tools."""
    return (
        jobs.groupBy("tool")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc_nulls_last("tool"))
        .limit(n)
    )
