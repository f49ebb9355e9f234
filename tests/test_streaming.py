"""Streams over several micro-batches give what the batch operators give."""

from __future__ import annotations

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from foliometer.operators import enrich, errors, lifecycle, limits
from foliometer.schemas import SCHEMAS
from foliometer.sources import events as event_feed
from foliometer.sources import files, tables
from foliometer.sources import visits as visit_source
from foliometer.streaming import activity, runner, visits
from foliometer.streaming.errors import error_stream
from foliometer.streaming.lifecycle import lifecycle_stream
from foliometer.streaming.limits import offender_stream
from test_operators import EVENT_LOG, expected_states, random_events

T0 = datetime(2024, 1, 1)


@pytest.fixture
def stream_of(spark):
    """Stream that reads slices of a time-ordered frame as one micro-batch each."""

    def build(df, time: str, cuts: int = 3):
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        moments = sorted(r[0] for r in df.select(time).distinct().collect())
        edges = [moments[len(moments) * i // cuts] for i in range(1, cuts)]
        for number in range(cuts):
            part = df
            if number > 0:
                part = part.filter(F.col(time) >= F.lit(edges[number - 1]))
            if number < cuts - 1:
                part = part.filter(F.col(time) < F.lit(edges[number]))
            part.coalesce(1).write.mode("append").parquet(folder)
        reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
        return reader.parquet(folder)

    return build


def raw_visits(frame, n=60):
    rng = random.Random(8)
    rows = [
        (f"{i:03d}", rng.choice("abcdefgh"), "s", "" if i % 9 == 0 else "/p",
         T0 + timedelta(hours=i // 2), None, None, "curl", None, "de")
        for i in range(n)
    ]
    schema = SCHEMAS["raw_visits"]
    return frame(rows, schema)


def test_visit_stream(frame, stream_of):
    raw = raw_visits(frame)
    valid, rejected = visit_source.split_visits(raw)
    got, quarantine = visits.ingest_visits(stream_of(raw, "created_at"))
    expected = enrich.enrich_visits(valid)
    columns = ["id", "visitor_id", "is_returning", "country", "source", "device"]
    assert rows_of(got, *columns) == rows_of(expected, *columns)
    assert rows_of(quarantine, "id") == rows_of(rejected, "id")


def test_trend_stream(frame, stream_of):
    stream = stream_of(raw_visits(frame).select("visitor_id", "created_at"), "created_at")
    expected = rows_of(
        raw_visits(frame)
        .groupBy(F.date_trunc("day", "created_at").alias("bucket"))
        .agg(F.countDistinct("visitor_id").alias("v"))
    )
    assert rows_of(visits.trend_stream(stream)) == expected
    assert rows_of(visits.trend_stream(stream, approx=True)) == expected


def test_trend_stream_leaves_out_visits_behind_the_watermark(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "visitor_id string, created_at timestamp"
    moments = [("a", T0), ("b", T0 + timedelta(days=3)), ("c", T0 + timedelta(days=4)), ("late", T0)]
    for row in moments:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = dict(rows_of(visits.trend_stream(stream, "monthly")))
    assert got == {T0: 3}


def test_limit_stream(frame, stream_of):
    rng = random.Random(9)
    rows = [(str(i), "up", rng.choice([None, "1", "2"]), T0 + timedelta(seconds=5 * i)) for i in range(90)]
    requests = frame(rows, "id string, bucket string, client_ip string, ts timestamp")
    columns = ["bucket", "client_ip", "minute", "requests", "rejected"]
    got = rows_of(offender_stream(stream_of(requests, "ts"), 3), *columns)
    assert got == rows_of(limits.window_counts(requests, 3), *columns)
    verdicts = limits.rate_limit(requests, 3).filter("rejected").count()
    assert verdicts == sum(row[-1] for row in got)


def test_error_stream(frame, stream_of):
    rng = random.Random(10)
    rows = [(f"{i:02d}", rng.choice("AB"), f"m{i}", T0 + timedelta(minutes=i), "f.py",
             rng.choice("xy"), f"/{i}", f"s{i}") for i in range(40)]
    events = frame(rows, SCHEMAS["error_events"])
    columns = SCHEMAS["error_logs"].fieldNames()
    got = rows_of(error_stream(stream_of(events, "ts")), *columns)
    assert got == rows_of(errors.collapse_errors(events), *columns)


def test_lifecycle_stream(frame, stream_of):
    rows = random_events(11)
    events = frame(rows, EVENT_LOG)
    got = rows_of(lifecycle_stream(stream_of(events, "ts", cuts=4)))
    assert got == expected_states(rows)
    assert got == rows_of(lifecycle.job_states(events))


def test_activity_stream(frame, stream_of):
    rng = random.Random(12)
    rows = [(str(i), rng.choice(["queued", "failed"]), T0 + timedelta(minutes=i)) for i in range(40)]
    jobs = frame(rows, "id string, status string, created_at timestamp")
    got = rows_of(activity.activity_stream(stream_of(jobs, "created_at")))
    assert got == rows_of(activity.activity_windows(jobs))


def test_repeated_batch_counts_once(spark, frame):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/log"
    df = frame([("a", 1)], "k string, v int")
    log = runner.KeyedLog(spark, folder, df.schema, ["k"])
    for _ in range(2):
        log.write(df, 0)
    log.write(frame([("a", 5), ("b", 2)], "k string, v int"), 1)
    assert rows_of(log.read()) == [("a", 5), ("b", 2)]
    assert rows_of(log.read(before=1)) == [("a", 1)]
    assert log.read(before=0).count() == 0


def test_stored_stream_of_visits(spark, frame, stream_of):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    queries = visit_source.write_visits(
        stream_of(raw_visits(frame), "created_at"), f"{folder}/v", f"{folder}/q", f"{folder}/c"
    )
    for query in queries:
        query.awaitTermination()
    assert spark.read.parquet(f"{folder}/v").count() + spark.read.parquet(f"{folder}/q").count() == 60


# ---- sources and sinks ---------------------------------------------------------------------


def test_binary_manifest(spark):
    import hashlib
    from pathlib import Path

    folder = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    (folder / "sub").mkdir()
    (folder / "a.bin").write_bytes(b"abc")
    (folder / "sub" / "b.bin").write_bytes(b"de")
    got = files.manifest(files.read_binary(spark, str(folder)))
    sizes = {r.path.rsplit("/", 1)[1]: (r.size_bytes, r.checksum_sha256) for r in got.collect()}
    assert sizes == {
        "a.bin": (3, hashlib.sha256(b"abc").hexdigest()),
        "b.bin": (2, hashlib.sha256(b"de").hexdigest()),
    }
    assert files.scratch_entries(spark, str(folder)).count() == 2
    limited = files.manifest(files.read_binary(spark, str(folder), largest=2))
    assert rows_of(limited.filter("error IS NOT NULL"), "size_bytes", "checksum_sha256", "error") == [
        (3, None, "file_too_large")]
    assert limited.filter("error IS NULL").count() == 1


def test_layout_by_day(spark, frame):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = frame([("1", T0), ("2", T0 + timedelta(days=40))], "id string, created_at timestamp")
    files.write_by_day(rows, folder)
    back = spark.read.parquet(folder).filter("month = 2")
    assert rows_of(back, "id") == [("2",)]
    allocated = files.allocate(rows, F.col("id"), F.lit("PDF"), F.col("created_at"))
    paths = sorted(r.relative_path for r in allocated.collect())
    assert paths[0].startswith("2024/01/01/") and paths[0].endswith(".pdf")


def test_seeding_is_idempotent(spark):
    catalogue = tables.tool_catalogue(spark)
    assert catalogue.count() == 30
    some = catalogue.limit(7)
    missing = tables.missing_rows(catalogue, some, "slug")
    assert missing.count() == 23
    assert tables.missing_rows(catalogue, some.unionByName(missing), "slug").count() == 0


def test_table_round_trip(spark, frame):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/users"
    tables.append_table(tables.tool_catalogue(spark), "tool_configs", folder)
    back = tables.read_table(spark, "tool_configs", folder)
    assert back.columns == SCHEMAS["tool_configs"].fieldNames()
    assert back.count() == 30


def test_event_round_trip(frame):
    jobs = frame([("1", "failed", 40, "E"), ("2", "queued", 0, None)],
                 "id string, status string, progress int, error_code string")
    encoded = event_feed.encode_events(jobs)
    back = event_feed.decode_events(encoded).drop("channel")
    assert rows_of(back) == rows_of(jobs)
    broken = encoded.withColumn("value", F.lit("{not json"))
    assert event_feed.decode_events(broken).filter("id IS NULL").count() == 2


def test_checkpoint_folder_comes_from_the_session(spark):
    from foliometer import session

    known = spark.conf.get("spark.checkpoint.dir", None)
    assert session.shared_dir(spark) == (known or spark.sparkContext.getCheckpointDir())
