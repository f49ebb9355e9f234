"""Upload batches, accepted or rejected as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.filetypes import sniff
from ..functions.measures import plan_limits
from .skew import without_hot_keys


def validate_uploads(items: DataFrame, check_types: bool = True) -> DataFrame:
    """Verdict per batch with the first failing file and its reason.

    ``items(batch_id, position, filename, head, size_bytes, plan)``. A batch over the
    plan's file count is rejected from its count alone; only batches of at most 100
    files reach the running total, so no window grows with the data. Very large ones among
    the oversized are left out before the shuffle; that changes no verdict.
    """
    plan = F.lower(F.coalesce(F.max("plan"), F.lit(C.DEFAULT_PLAN)))
    batches = (
        items.groupBy("batch_id")
        .agg(F.count("*").alias("rows"), plan.alias("plan"))
        .withColumn("n_files", F.col("rows"))
        .withColumn("limits", plan_limits("plan"))
        .withColumn("oversized", F.col("n_files") > F.col("limits.max_files"))
    )
    small = batches.filter(~F.col("oversized")).select("batch_id", "limits")
    before = (
        W.partitionBy("batch_id")
        .orderBy("position")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    kind = sniff("filename", "head")["error"] if check_types else F.lit(None).cast("string")
    taken = F.coalesce(F.sum("size_bytes").over(before), F.lit(0))
    remaining = F.col("limits.max_total_bytes") - F.col("taken")
    per_file = F.col("limits.max_file_bytes")
    problem = F.coalesce(
        F.col("kind"),
        F.when(
            F.col("size_bytes") > F.least(per_file, remaining),
            F.when(remaining < per_file, "combined_limit").otherwise("file_limit"),
        ),
    )
    failures = (
        without_hot_keys(items, batches.filter("oversized"), ["batch_id"])
        .withColumn("kind", kind)
        .select("batch_id", "position", "size_bytes", "kind")
        .join(small, "batch_id", "inner")
        .withColumn("taken", taken)
        .withColumn("problem", problem)
        .groupBy("batch_id")
        .agg(
            F.min(
                F.when(F.col("problem").isNotNull(), F.struct("position", "problem"))
            ).alias("first")
        )
    )
    reason = F.when(F.col("oversized"), "too_many_files").otherwise(F.col("first.problem"))
    return batches.join(failures, "batch_id", "left").select(
        "batch_id",
        "n_files",
        reason.isNull().alias("accepted"),
        reason.alias("reason"),
        F.col("first.position").alias("failed_position"),
    )
