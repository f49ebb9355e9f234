"""Running totals over groups of any size.

A window function sorts a whole group in one task. Where a group may hold a
large part of the table, the rows are range-partitioned by (group, order)
instead, totalled inside each partition, and shifted by the totals of the same
group in earlier partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def running_total(df: DataFrame, keys, order, value: Column, name: str) -> DataFrame:
    """Add ``name``: the total of ``value`` up to and including the row, per group.

    Rows equal in ``keys`` and ``order`` get an arbitrary but fixed order, so even
    a group of copies is spread over partitions.
    """
    keys, order = list(keys), list(order)
    # Row numbers and slice numbers depend on the partitioning they were taken in. Both
    # are stored before use, so that a lost executor cannot bring different ones back.
    numbered = cut_lineage(
        df.withColumn("__value", value).withColumn("__row", F.monotonically_increasing_id())
    )
    sorting = [*keys, *order, "__row"]
    sliced = cut_lineage(
        numbered.repartitionByRange(*sorting).withColumn("__slice", F.spark_partition_id())
    )
    local = W.partitionBy(*keys, "__slice").orderBy(*order, "__row").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    earlier = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    # A group has a shift only where it crosses a slice boundary: at most one row per slice.
    shifts = (
        sliced.groupBy(*keys, "__slice")
        .agg(F.sum("__value").alias("__sum"))
        .withColumn("__shift", F.sum("__sum").over(earlier))
        .filter(F.col("__shift").isNotNull())
        .drop("__sum")
    )
    condition = [F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")) for key in [*keys, "__slice"]]
    joined = sliced.withColumn("__local", F.sum("__value").over(local)).alias("a").join(
        F.broadcast(shifts.alias("b")), condition, "left"
    )
    total = F.col("a.__local") + F.coalesce(F.col("b.__shift"), F.lit(0))
    return joined.select(*[F.col(f"a.`{column}`") for column in df.columns], total.alias(name))
