"""Key figures of the admin panel's pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.filters import timestamp
from ..functions.measures import month_name, page_total, share_pct


def _amount(column: str, condition):
    return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0))


def _midnight(now):
    return F.date_trunc("day", timestamp(now))


def overview(users, jobs, subscriptions, files, feedback, now) -> DataFrame:
    """A1: headline figures. One pass per table; the one-row results are added up.

    Revenue counts every active subscription, whatever its interval.
    """
    active = F.col("status") == "active"
    parts = [
        users.agg(F.count("*").alias("total_users")),
        jobs.agg(
            F.countDistinct("user_id").alias("active_users"),
            F.count("*").alias("total_conversions"),
            F.count_if(F.col("created_at") >= _midnight(now)).alias("today_conversions"),
            F.count_if(F.col("status") == "failed").alias("failed_jobs"),
        ),
        subscriptions.agg(
            F.count_if(active).alias("total_subscribers"),
            _amount("price_cents", active).alias("monthly_revenue_cents"),
        ),
        files.agg(_amount("size_bytes", active).alias("storage_bytes")),
        feedback.agg(F.count("*").alias("total_feedback")),
    ]
    figures = [name for part in parts for name in part.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in figures])


def monthly_conversions(jobs: DataFrame) -> DataFrame:
    """Jobs per month, labelled by month name alone, with the month start beside it."""
    return (
        jobs.groupBy(F.date_trunc("month", "created_at").alias("bucket"))
        .agg(F.count("*").alias("v"))
        .select("bucket", month_name("bucket").alias("m"), "v")
        .orderBy("bucket")
    )


def user_stats(users: DataFrame) -> DataFrame:
    """Users in total, active, suspended, and on any plan but the free one."""
    return users.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "suspended").alias("suspended"),
        F.count_if(F.col("plan") != C.DEFAULT_PLAN).alias("pro"),
    )


def subscription_stats(subscriptions: DataFrame, interval: str = "interval") -> DataFrame:
    """Active and expired subscriptions, monthly recurring revenue, churn."""
    active = F.col("status") == "active"
    counted = subscriptions.agg(
        F.count_if(active).alias("active"),
        F.count_if(F.col("status") == "expired").alias("expired"),
        _amount("price_cents", active & (F.col(interval) == "monthly")).alias("mrr_cents"),
    )
    churn = share_pct(F.col("expired"), F.col("active") + F.col("expired"))
    return counted.withColumn("churn", churn)


def file_stats(files: DataFrame) -> DataFrame:
    """Active files and bytes per category, and over all of them (``is_total``)."""
    return (
        files.filter(F.col("status") == "active")
        .rollup("category")
        .agg(
            F.grouping("category").cast("boolean").alias("is_total"),
            F.count("*").alias("files"),
            F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
        )
    )


def job_stats(jobs: DataFrame) -> DataFrame:
    """Jobs by stage; pending counts as queued, cancelled and expired not at all."""
    status = F.col("status")
    return jobs.agg(
        F.count_if(status == "processing").alias("processing"),
        F.count_if(status.isin("queued", "pending")).alias("queued"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status == "failed").alias("failed"),
    )


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Feedback per category and in total (``is_total``)."""
    return feedback.rollup("category").agg(
        F.grouping("category").cast("boolean").alias("is_total"), F.count("*").alias("n")
    )


def unread_messages(messages: DataFrame) -> DataFrame:
    """A22."""
    return messages.agg(F.count_if(~F.col("is_read")).alias("unread"))


def health(jobs: DataFrame, now) -> DataFrame:
    """Waiting jobs, failures within the last hour, and the worker verdict."""
    recent = F.col("finished_at") >= timestamp(now) - F.expr("INTERVAL 1 HOUR")
    counted = jobs.agg(
        F.count_if(F.col("status").isin("queued", "pending")).alias("pending_jobs"),
        F.count_if((F.col("status") == "failed") & recent).alias("recent_failures"),
    )
    verdict = F.when(F.col("recent_failures") > 0, "Warning").otherwise("Healthy")
    return counted.withColumn("worker_status", verdict)


def live_activity(jobs: DataFrame, now) -> DataFrame:
    """Running and queued jobs (pending ones not), jobs since midnight."""
    return jobs.agg(
        F.count_if(F.col("status").isin("processing", "queued")).alias("active_jobs"),
        F.count_if(F.col("created_at") >= _midnight(now)).alias("today_jobs"),
    )


def phase_timing(phase_events: DataFrame) -> DataFrame:
    """Work per job and phase in milliseconds, and number of calls."""
    return phase_events.groupBy("job_id", "phase").agg(
        F.round(F.sum("seconds") * 1000, 1).alias("phase_ms"), F.count("*").alias("calls")
    )


def page_counts(df: DataFrame, size: int) -> DataFrame:
    """Rows and pages of a listing."""
    return df.agg(F.count("*").alias("total")).withColumn(
        "pages", page_total(F.col("total"), F.lit(size))
    )


def user_details(users, jobs, files, subscriptions) -> DataFrame:
    """Every user with job and file counts and the newest subscription.

    The three facts are reduced to one row per user before they are joined.
    """
    newest = F.max_by(F.struct(*subscriptions.columns), F.struct("created_at", "id"))
    latest = subscriptions.groupBy(F.col("user_id").alias("id")).agg(newest.alias("subscription"))
    return (
        users.join(rows_per_user(jobs, "conversions"), "id", "left")
        .join(rows_per_user(files, "files_count"), "id", "left")
        .join(latest, "id", "left")
        .na.fill(0, ["conversions", "files_count"])
    )


def rows_per_user(df: DataFrame, name: str) -> DataFrame:
    """Rows per owner; rows without an owner match nobody and are left out."""
    owned = df.filter(F.col("user_id").isNotNull())
    return owned.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias(name))
