"""Numbers and labels on dashboards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import col

UNITS = {"yearly": "year", "monthly": "month", "weekly": "week"}


def trend_bucket(ts: Column | str, group_by: str | None) -> Column:
    """Start of the day, week, month or year; an unknown unit means days."""
    return F.date_trunc(UNITS.get(group_by or "", "day"), col(ts))


def trend_label(bucket: Column | str, group_by: str | None) -> Column:
    """Axis label of a bucket start."""
    bucket = col(bucket)
    if group_by == "yearly":
        return F.date_format(bucket, "yyyy")
    if group_by == "monthly":
        return F.date_format(bucket, "MMM yyyy")
    if group_by == "weekly":
        week = F.weekofyear(bucket).cast("string")
        return F.concat(F.lit("Wk "), week, F.lit(" ("), F.date_format(bucket, "yyyy"), F.lit(")"))
    return F.date_format(bucket, "MMM dd")


def month_name(bucket: Column | str) -> Column:
    return F.date_format(col(bucket), "MMM")


def growth_pct(current: Column, previous: Column) -> Column:
    """Change against the previous period, 0.0 where that was zero."""
    change = (current - previous) / previous * 100
    return F.when(previous != 0, F.round(change, 1)).otherwise(F.lit(0.0))


def share_pct(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """Share in percent, ``empty`` where there is nothing to share."""
    return F.when(whole != 0, F.round(part * 100.0 / whole, 1)).otherwise(F.lit(empty))


def human_size(size: Column | str) -> Column:
    """Byte count for humans. Ties round to even, as decimal formatting does."""
    size = col(size)

    def scaled(power: int, unit: str) -> Column:
        value = F.bround(size.cast("double") / F.lit(float(1024**power)), 1)
        return F.format_string(f"%.1f {unit}", value)

    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, scaled(1, "KB"))
        .when(size < 1024**3, scaled(2, "MB"))
        .when(size < 1024**4, scaled(3, "GB"))
        .otherwise(scaled(4, "TB"))
    )


def clamp_progress(progress: Column | str) -> Column:
    """Progress within 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), col(progress)))


def step_progress(done: Column, total: Column, ceiling: int = C.PROGRESS_CEILING) -> Column:
    """Progress after ``done`` of ``total`` inputs, below a ceiling."""
    return F.floor(done / total * ceiling).cast("int")


def page_total(total: Column, size: Column) -> Column:
    """Number of pages, zero for a page size of zero."""
    return F.when(size != 0, F.ceil(total / size)).otherwise(F.lit(0)).cast("long")


def feedback_label(category: Column | str) -> Column:
    """Display name of a feedback category; an unknown one is shown as it is."""
    category = col(category)
    pairs = [F.lit(word) for pair in C.FEEDBACK_LABELS.items() for word in pair]
    return F.coalesce(F.create_map(*pairs)[category], category)


def enum_rank(column: Column | str, order) -> Column:
    """Position of an enumeration value in its declaration order."""
    return F.array_position(F.array(*[F.lit(value) for value in order]), col(column))


def plan_limits(plan: Column | str) -> Column:
    """struct(max_files, max_file_bytes, max_total_bytes) of a plan name."""

    def limits(name: str) -> Column:
        files, per_file, total = C.PLAN_LIMITS[name]
        return F.struct(
            F.lit(files).cast("long").alias("max_files"),
            F.lit(per_file * C.MEGABYTE).cast("long").alias("max_file_bytes"),
            F.lit(total * C.MEGABYTE).cast("long").alias("max_total_bytes"),
        )

    plan = F.lower(col(plan))
    chosen = F.when(plan == C.DEFAULT_PLAN, limits(C.DEFAULT_PLAN))
    for name in C.PLAN_LIMITS:
        chosen = chosen.when(plan == name, limits(name))
    return chosen.otherwise(limits(C.DEFAULT_PLAN))
