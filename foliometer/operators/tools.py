"""Tool dashboard: executions, processed files, success rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.filters import dashboard_filters
from ..functions.measures import share_pct
from .traffic import tool_usage


def input_links(job_files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Input links of the given jobs.

    A job with very many links is split by the adaptive skew join.
    """
    links = job_files.filter(F.col("role") == "input").select("job_id", "file_id")
    return links.join(jobs.select(F.col("id").alias("job_id"), "tool"), "job_id", "inner")


def input_files(job_files: DataFrame, jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Input links of the given jobs with the size of the file; missing files drop out."""
    sizes = files.select(F.col("id").alias("file_id"), "size_bytes")
    return input_links(job_files, jobs).join(sizes, "file_id", "inner")


def tool_counts(jobs: DataFrame, params=None, now=None) -> DataFrame:
    """Total, successful and failed jobs per tool."""
    status = F.col("status")
    return (
        dashboard_filters(jobs, params, now)
        .groupBy("tool")
        .agg(
            F.count("*").alias("total"),
            F.count_if(status == "completed").alias("success"),
            F.count_if(status == "failed").alias("failed"),
        )
    )


def tool_files(jobs, job_files, files, params=None, now=None) -> DataFrame:
    """Input links, found input files and their bytes per tool."""
    chosen = dashboard_filters(jobs, params, now)
    sizes = files.select(F.col("id").alias("file_id"), F.lit(1).alias("found"), "size_bytes")
    return (
        input_links(job_files, chosen)
        .join(sizes, "file_id", "left")
        .groupBy("tool")
        .agg(
            F.count("*").alias("links"),
            F.count("found").alias("files"),
            F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
        )
    )


def tool_activity(jobs, job_files, files, params=None, now=None) -> DataFrame:
    """A8 and A9 side by side, one row per tool that ran."""
    counts = tool_counts(jobs, params, now)
    processed = tool_files(jobs, job_files, files, params, now)
    figures = ("total", "success", "failed", "links", "files", "bytes")
    # A handful of rows each: adding them up is cheaper than a join.
    return (
        counts.unionByName(processed, allowMissingColumns=True)
        .groupBy("tool")
        .agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in figures])
    )


def tool_kpis(jobs, job_files, files, params=None, now=None) -> DataFrame:
    """Jobs, outcomes, input files and input bytes over all tools."""
    total = {
        "total_executions": "total",
        "success_executions": "success",
        "failed_executions": "failed",
        "total_files_processed": "links",
        "total_data_processed_bytes": "bytes",
    }
    activity = tool_activity(jobs, job_files, files, params, now)
    return activity.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(alias) for alias, name in total.items()]
    )


def tool_scorecard(jobs, job_files, files, tool_configs, params=None, now=None) -> DataFrame:
    """Every configured tool with its counts; unused tools score 100.0.

    Jobs of tools without a configuration do not appear here.
    """
    activity = tool_activity(jobs, job_files, files, params, now).withColumnRenamed("tool", "slug")
    return (
        tool_configs.select("slug", "name", "category", "sort_order")
        .join(activity, "slug", "left")
        .na.fill(0, ["total", "success", "failed", "files", "bytes"])
        .select(
            "slug",
            "name",
            "category",
            "sort_order",
            F.col("total").alias("usage_count"),
            F.col("success").alias("success_count"),
            F.col("failed").alias("failure_count"),
            share_pct(F.col("success"), F.col("total"), empty=100.0).alias("success_rate"),
            F.col("files").alias("files_processed"),
            F.col("bytes").alias("data_processed_bytes"),
        )
    )


def tool_extremes(scorecard: DataFrame) -> DataFrame:
    """Most popular and least used tool of a scorecard.

    Ordered by usage, ties in configuration order. ``least_used`` is the last tool
    with any use, or the last one of all when nothing was used.
    """
    place = F.struct(-F.col("usage_count"), F.col("sort_order"), F.col("name"))
    used = F.col("usage_count") > 0
    return scorecard.agg(
        F.coalesce(F.min_by(F.when(used, F.col("name")), place), F.lit("None")).alias(
            "most_popular_tool"
        ),
        F.coalesce(
            F.max_by("name", F.when(used, place)), F.max_by("name", place), F.lit("None")
        ).alias("least_used_tool"),
    )


def usage_share(jobs: DataFrame, n: int) -> DataFrame:
    """Share of each of the ``n`` most used tools in their common total.

    The window covers the ``n`` rows that are left after the limit.
    """
    total = F.sum("count").over(W.partitionBy(F.lit(0)))
    return tool_usage(jobs, n).select(
        "tool", "count", share_pct(F.col("count"), total).alias("pct")
    )


def tool_list(tool_configs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Configured tools in display order with their number of jobs."""
    usage = jobs.groupBy(F.col("tool").alias("slug")).agg(F.count("*").alias("usage"))
    return (
        tool_configs.join(usage, "slug", "left")
        .na.fill(0, ["usage"])
        .orderBy("sort_order", "name")
    )
