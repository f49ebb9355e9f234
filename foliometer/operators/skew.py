"""Joining rows to a summary of their own key when one key may hold most of the rows.

Adaptive execution splits a hot partition only where both join inputs come straight
from a shuffle. A summary per key does not: it is aggregated after its shuffle. So the
few hot keys are found by counting and spread explicitly.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one key that a single task may join; a session may set another number.
HOT_ROWS = 5_000_000
HOT_ROWS_SETTING = "spark.foliometer.hotRows"
NULL_PARTS = 4096


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS)))


def attach(
    facts: DataFrame, summary: DataFrame, keys, row_key, counts: DataFrame | None = None,
    how: str = "left",
) -> DataFrame:
    """Join ``facts`` to ``summary``, which has one row per key, without hot tasks.

    ``counts`` holds the number of rows per key as ``rows``; it is taken from ``facts``
    where the caller has none. Keys with more rows than a task should join are divided
    by a hash of ``row_key``, and their summary row is repeated as often. There are at
    most (all rows / 2 HOT_ROWS) such keys, which bounds the broadcast: 100,000 keys for
    10^12 rows. Rows with a NULL key match nothing and are spread likewise.
    """
    keys = list(keys)
    limit = hot_rows(facts.sparkSession)
    if counts is None:
        counts = facts.groupBy(*keys).agg(F.count("*").alias("rows"))
    parts = F.ceil(F.col("rows") / limit).cast("int").alias("__parts")
    hot = F.broadcast(counts.filter(F.col("rows") >= 2 * limit).select(*keys, parts))

    no_key = reduce(or_, [F.col(key).isNull() for key in keys])
    divided = F.coalesce("__parts", F.lit(1))
    salt = F.pmod(F.xxhash64(*row_key), F.when(no_key, NULL_PARTS).otherwise(divided))
    salted = facts.join(hot, keys, "left").withColumn("__salt", salt.cast("int")).drop("__parts")
    repeated = (
        summary.join(hot, keys, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), divided - 1)))
        .drop("__parts")
    )
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")


def without_hot_keys(facts: DataFrame, counts: DataFrame, keys) -> DataFrame:
    """Rows of all keys but those too large for one task, dropped before any shuffle."""
    limit = hot_rows(facts.sparkSession)
    hot = counts.filter(F.col("rows") >= 2 * limit).select(*keys)
    return facts.join(F.broadcast(hot), list(keys), "left_anti")
