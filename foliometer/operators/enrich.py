"""Attribution of visits and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import traffic
from .skew import attach


def mark_returning(visits: DataFrame) -> DataFrame:
    """``is_returning`` is true for every visit after the visitor's first.

    The first visit per visitor is a plain aggregation and is joined back, so a
    visitor with very many visits is never sorted in one task.
    """
    reduced = visits.groupBy("visitor_id").agg(
        F.min(F.struct("created_at", "id")).alias("__first"), F.count("*").alias("rows")
    )
    first, counts = reduced.drop("rows"), reduced.drop("__first")
    joined = attach(visits, first, ["visitor_id"], ["id"], counts)
    later = F.struct("created_at", "id") > F.col("__first")
    return joined.select(*visits.columns, F.coalesce(later, F.lit(False)).alias("is_returning"))


def classify_visits(raw: DataFrame) -> DataFrame:
    """E1, E2, E3 over raw visits: device, browser, os, country, source."""
    agent = traffic.user_agent("user_agent")
    return (
        raw.withColumn("__agent", agent)
        .withColumns(
            {
                "os": F.col("__agent.os"),
                "device": F.col("__agent.device"),
                "browser": F.col("__agent.browser"),
                "country": traffic.country("accept_language", "cdn_country"),
                "source": traffic.visit_source("source", "referrer"),
            }
        )
        .drop("__agent", "user_agent", "accept_language", "cdn_country")
    )


def enrich_visits(raw: DataFrame) -> DataFrame:
    """S2 in batch: classified visits with the returning flag."""
    return mark_returning(classify_visits(raw))


def session_sources(visits: DataFrame) -> DataFrame:
    """Traffic source of each session, taken from its earliest visit."""
    first = F.min_by("source", F.struct("created_at", "id"))
    return (
        visits.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(first.alias("source"))
    )


def attribute_sources(jobs: DataFrame, visits: DataFrame) -> DataFrame:
    """Jobs with the traffic source of their session, ``Direct`` by default."""
    joined = attach(jobs, session_sources(visits), ["session_id"], ["id"])
    source = F.when(F.coalesce(F.col("source"), F.lit("")) != "", F.col("source"))
    return joined.withColumn("source", F.coalesce(source, F.lit(C.DIRECT_SOURCE)))


def seen_before(jobs: DataFrame, visits: DataFrame) -> DataFrame:
    """``is_returning`` of jobs: the visitor had a visit before the job.

    Visits are reduced to the first one per visitor, which keeps an equi-join.
    """
    first = (
        visits.filter(F.col("visitor_id").isNotNull())
        .groupBy("visitor_id")
        .agg(F.min("created_at").alias("__since"))
    )
    joined = attach(jobs, first, ["visitor_id"], ["id"])
    seen = F.coalesce(F.col("__since") < F.col("created_at"), F.lit(False))
    return joined.withColumn("is_returning", seen).drop("__since")


def enrich_jobs(jobs: DataFrame, visits: DataFrame) -> DataFrame:
    """Session source and returning flag of jobs."""
    return seen_before(attribute_sources(jobs, visits), visits)
