"""One key holds a third of all rows: results stay whole and hot partitions are split."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliometer.operators import enrich, jobs, lifecycle, limits, tools, uploads
from foliometer.operators.skew import HOT_ROWS_SETTING, attach

ROWS = 300_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_partitions(spark):
    """Thresholds scaled down to the test's data, as if it were large."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def skewed(spark, name):
    """Rows of which a third share the key ``hot``."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.sha2(F.col("id").cast("string"), 256))
    moment = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    return (
        spark.range(0, ROWS, 1, 16)
        .withColumn(name, key)
        .withColumn("created_at", moment)
        .withColumn("id", F.sha2(F.concat(F.lit("row"), F.col("id").cast("string")), 256))
    )


def final_plan(df):
    """Row count of ``df`` and the plan adaptive execution arrived at."""
    execution = df._jdf.queryExecution()
    total = execution.toRdd().count()
    return total, execution.executedPlan().toString()


def largest_partition(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


@pytest.fixture
def low_hot_limit(spark):
    spark.conf.set(HOT_ROWS_SETTING, "5000")
    yield
    spark.conf.unset(HOT_ROWS_SETTING)


def test_returning_visitors(spark, small_partitions, low_hot_limit):
    visits = enrich.mark_returning(skewed(spark, "visitor_id"))
    assert visits.count() == ROWS
    assert visits.filter("is_returning").count() == ROWS // 3 - 1
    assert largest_partition(visits) < ROWS // 6


def test_attach_joins_every_row_once(spark, low_hot_limit):
    facts = skewed(spark, "k").withColumn("k", F.when(F.col("id") > "3", F.col("k")))
    summary = facts.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    joined = attach(facts, summary, ["k"], ["id"])
    assert joined.count() == ROWS
    assert joined.filter("n IS NULL").count() == facts.filter("k IS NULL").count()
    hot = facts.filter("k = 'hot'").count()
    assert joined.filter("k = 'hot'").select("n").distinct().first()[0] == hot
    assert attach(facts, summary, ["k"], ["id"], how="inner").filter("k = 'hot'").count() == hot


def test_hot_batch_is_rejected_without_a_shuffle(spark, low_hot_limit):
    items = skewed(spark, "batch_id").select(
        "batch_id",
        F.col("id").alias("position"),
        F.lit("a.pdf").alias("filename"),
        F.lit(b"%PDF-").alias("head"),
        F.lit(1).cast("long").alias("size_bytes"),
        F.lit("pro").alias("plan"),
    )
    verdicts = uploads.validate_uploads(items)
    assert verdicts.filter("NOT accepted").select("batch_id", "reason").collect() == [
        ("hot", "too_many_files")
    ]
    assert verdicts.count() == ROWS - ROWS // 3 + 1


def test_job_states_of_a_chatty_job(spark, low_hot_limit):
    events = skewed(spark, "job_id").select(
        "job_id",
        F.lit("progress").alias("kind"),
        F.col("created_at").alias("ts"),
        F.unix_seconds("created_at").alias("seq"),
        F.lit(7).alias("progress"),
        F.lit(None).cast("string").alias("error_code"),
    )
    states = lifecycle.job_states(events)
    assert states.count() == ROWS - ROWS // 3 + 1
    assert states.select("status", "progress").distinct().collect() == [("pending", 7)]


def test_anonymous_owners_do_not_meet(spark, small_partitions):
    rows = skewed(spark, "user_id").withColumn(
        "user_id", F.when(F.col("user_id") != "hot", F.col("user_id"))
    )
    users = rows.filter("user_id IS NOT NULL").select(
        F.col("user_id").alias("id"), F.lit("x").alias("email")
    )
    found = jobs.with_user_email(rows, users)
    assert found.count() == ROWS
    assert found.filter("user_email IS NULL").count() == ROWS // 3
    assert largest_partition(found) < ROWS // 3


def test_input_files_of_a_hot_job(spark, small_partitions):
    links = skewed(spark, "job_id").select(
        "job_id", F.col("id").alias("file_id"), F.lit("input").alias("role")
    )
    quiet = links.filter("job_id != 'hot'").select(F.col("job_id").alias("id"))
    hot = spark.range(1).select(F.lit("hot").alias("id"))
    all_jobs = quiet.unionByName(hot).withColumn("tool", F.lit("t"))
    files = links.select(F.col("file_id").alias("id"), F.lit(1).cast("long").alias("size_bytes"))
    total, plan = final_plan(tools.input_files(links, all_jobs, files))
    assert total == ROWS
    assert "skew=true" in plan


def test_rate_limit_of_one_busy_client(spark, small_partitions, low_hot_limit):
    requests = skewed(spark, "client_ip").select(
        "id",
        F.lit("upload").alias("bucket"),
        "client_ip",
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"),
    )
    verdicts = limits.rate_limit(requests, 5)
    assert verdicts.filter("rejected").count() == ROWS // 3 - 5
    assert "Partial" in verdicts._jdf.queryExecution().executedPlan().toString()
