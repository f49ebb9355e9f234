"""State that lasts: streams over many batches and restarts, keyed logs, event folders, files, folds."""

from __future__ import annotations

import hashlib
import os
import random
import shutil
import tempfile
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows_of
from foliometer.operators import components, enrich, errors, folds, lifecycle, limits
from foliometer.schemas import SCHEMAS
from foliometer.sources import events as event_feed
from foliometer.sources import files
from foliometer.sources import visits as visit_source
from foliometer.streaming import activity, runner, visits
from foliometer.streaming import errors as error_streams
from foliometer.streaming import lifecycle as lifecycle_streams
from foliometer.streaming import limits as limit_streams
from test_operators import EVENT_LOG, expected_states, random_events

T0 = datetime(2024, 1, 1)
BATCHES = 22


def new_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture
def slices(spark):
    """(folder, stream, feed): ``feed(first, last)`` puts files of a frame into the folder in order of time."""

    def build(df, time: str, cuts: int = BATCHES):
        store, folder = new_folder(), new_folder()
        rows = sorted(df.collect(), key=lambda r: r[time])
        for number in range(cuts):
            part = rows[len(rows) * number // cuts : len(rows) * (number + 1) // cuts]
            spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{store}/{number}")

        def feed(first: int, last: int) -> None:
            for number in range(first, last):
                (part,) = Path(f"{store}/{number}").glob("*.parquet")
                shutil.copy(part, f"{folder}/.{number:03d}")
                # Files are taken in the order of their times.
                os.utime(f"{folder}/.{number:03d}", (1e9 + number, 1e9 + number))
                os.rename(f"{folder}/.{number:03d}", f"{folder}/{number:03d}.parquet")

        reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
        return reader.parquet(folder), feed

    return build


def raw_visits(frame, n=440):
    rng = random.Random(4)
    people = ["busy"] * 6 + [f"v{i}" for i in range(60)]
    rows = [
        (f"{i:04d}", rng.choice(people), "s", "" if i % 31 == 0 else "/p",
         T0 + timedelta(minutes=i), None, None, "curl", None, "de")
        for i in range(n)
    ]
    return frame(rows, SCHEMAS["raw_visits"])


def test_visits_over_many_batches_and_restarts(spark, frame, slices):
    raw = raw_visits(frame)
    stream, feed = slices(raw, "created_at")
    folder = new_folder()
    sizes = []
    for first, last in ((0, 9), (9, 10), (10, BATCHES)):
        feed(first, last)
        rows, rejected = visits.start_visits(stream, folder)
        rows.awaitTermination()
        rejected.awaitTermination()
        sizes += [p["numInputRows"] for p in rows.recentProgress if p["numInputRows"]]
    assert sizes == [raw.count() // BATCHES] * BATCHES  # nothing of the past is read again
    expected = enrich.enrich_visits(visit_source.split_visits(raw)[0])
    got = spark.read.parquet(f"{folder}/rows")
    columns = ["id", "visitor_id", "is_returning", "country", "created_at"]
    assert rows_of(got, *columns) == rows_of(expected, *columns)
    assert spark.read.parquet(f"{folder}/quarantine").count() == raw.filter("path = ''").count()


def test_a_running_query_takes_up_what_arrives(spark, frame, slices):
    raw = raw_visits(frame, 60)
    stream, feed = slices(raw, "created_at", 3)
    folder = new_folder()
    rows, rejected = visits.start_visits(stream, folder, every="0 seconds")
    for part in range(3):
        feed(part, part + 1)
        rows.processAllAvailable()
    for query in (rows, rejected):
        query.stop()
        query.awaitTermination()
    expected = enrich.enrich_visits(visit_source.split_visits(raw)[0])
    assert rows_of(spark.read.parquet(f"{folder}/rows"), "id", "is_returning") == rows_of(expected, "id", "is_returning")


def test_only_one_visit_per_arrow_batch_goes_to_a_visitors_task(spark, frame):
    rows = [(f"{i:05d}", "busy", T0 + timedelta(seconds=i)) for i in range(30_000)]
    df = frame(rows, "id string, visitor_id string, created_at timestamp").coalesce(1)
    routed = visits.with_routes(df)
    assert routed.filter("route = 'visitor busy'").count() <= 4
    assert routed.filter("route like 'rest %'").select("route").distinct().count() > 3000


# ---- keyed logs ----------------------------------------------------------------------------


def log_of(spark, **settings):
    return runner.KeyedLog(spark, f"{new_folder()}/log", T.StructType.fromDDL("k string, v long"), ["k"], **settings)


def test_keyed_log_reads_a_bounded_number_of_files(spark, frame):
    log = log_of(spark, every=4, buckets=4)
    rng, state, opened = random.Random(1), {}, []
    for batch in range(BATCHES):
        changes = {f"k{rng.randrange(40)}": batch * 100 + i for i in range(10)}
        before = dict(state)
        state |= changes
        assert dict(rows_of(log.read(before=batch))) == before
        opened.append(len(log._rows(batch).inputFiles()))
        log.write(frame(list(changes.items()), "k string, v long").coalesce(1), batch)
        assert dict(rows_of(log.read())) == state
    assert max(opened) <= 4 + 4  # one snapshot of four buckets and fewer than four batches
    assert len(log._pointers()) == runner.SNAPSHOTS_KEPT
    assert len(log._batches()) <= 2 * 4


def test_touched_keys_open_their_buckets_only(spark, frame):
    log = log_of(spark, every=1, buckets=16)
    rows = frame([(f"k{i}", i) for i in range(200)], "k string, v long")
    log.write(rows, 0)
    touched = rows.filter("k = 'k7'")
    assert rows_of(log.read(touched=touched)) == [("k7", 7)]
    partitions = log._rows(None, touched).select(F.input_file_name()).distinct().collect()
    assert len({Path(r[0]).parent.name for r in partitions}) == 1


def test_a_merge_that_is_cut_off_leaves_the_old_snapshot(spark, frame):
    log = log_of(spark, every=100)
    for batch in range(3):
        log.write(frame([("a", batch), (f"b{batch}", 1)], "k string, v long"), batch)
    log.publish(log.build(2), 2)
    whole = rows_of(log.read())
    log.build(2)  # written, but its pointer is not
    (folder,) = {name for name in log._names("snapshots")} - {name for _, name in log._pointers()}
    for part in Path(log.folder, "snapshots", folder).rglob("*.parquet"):
        part.write_bytes(b"cut off")
    assert rows_of(log.read()) == whole
    log.write(frame([("a", 9)], "k string, v long"), 3)
    assert dict(rows_of(log.read()))["a"] == 9
    log.publish(log.build(3), 3)
    assert dict(rows_of(log.read())) == dict(whole) | {"a": 9}
    assert folder not in log._names("snapshots")


def test_a_batch_repeated_after_its_snapshot_sees_the_state_before_it(spark, frame):
    log = log_of(spark, every=2)
    for batch in range(4):
        log.write(frame([("a", batch)], "k string, v long"), batch)
    assert rows_of(log.read(before=3)) == [("a", 2)]
    log.write(frame([("a", 3)], "k string, v long"), 3)
    assert rows_of(log.read()) == [("a", 3)]


def error_events(frame):
    rng = random.Random(10)
    rows = [(f"{i:03d}", rng.choice("ABC"), f"m{i}", T0 + timedelta(minutes=i), "f.py",
             rng.choice("xyz"), f"/{i}", f"s{i}") for i in range(220)]
    return frame(rows, SCHEMAS["error_events"])


def test_error_log_over_restarts(frame, slices):
    events = error_events(frame)
    stream, feed = slices(events, "ts", 6)
    folder = new_folder()
    for first, last in ((0, 1), (1, 4), (4, 6)):
        feed(first, last)
        table = error_streams.keep_error_log(stream, folder)
        table.query.awaitTermination()
    columns = SCHEMAS["error_logs"].fieldNames()
    assert rows_of(table.rows(), *columns) == rows_of(errors.collapse_errors(events), *columns)


def test_states_over_restarts(frame, slices):
    rows = random_events(11)
    events = frame(rows, EVENT_LOG)
    stream, feed = slices(events, "ts", 5)
    folder = new_folder()
    for first, last in ((0, 2), (2, 3), (3, 5)):
        feed(first, last)
        table = lifecycle_streams.keep_states(stream, folder)
        table.query.awaitTermination()
    assert rows_of(table.rows(), "job_id", "status", "progress", "error_code") == expected_states(rows)


def test_windows_stay_current_over_restarts(frame, slices):
    rng = random.Random(9)
    rows = [(str(i), "up", rng.choice([None, "1", "2"]), T0 + timedelta(seconds=5 * i)) for i in range(220)]
    requests = frame(rows, "id string, bucket string, client_ip string, ts timestamp")
    stream, feed = slices(requests, "ts", 8)
    folder = new_folder()
    table = limit_streams.keep_windows(stream, folder, every="0 seconds")
    for first, last in ((0, 3), (3, 4), (4, 8)):
        feed(first, last)
        table.query.processAllAvailable()
        table.stop()
        table = limit_streams.keep_windows(stream, folder, every="0 seconds")
    table.query.processAllAvailable()
    table.stop()
    # The watermark has closed the early windows: their state is gone, their rows are not.
    state = [p["stateOperators"][0]["numRowsTotal"] for p in table.query.recentProgress if p["stateOperators"]]
    columns = ["bucket", "client_ip", "minute", "requests", "rejected"]
    got = rows_of(limit_streams.with_rejections(table.rows(), 3), *columns)
    assert got == rows_of(limits.window_counts(requests, 3), *columns)
    assert not state or state[-1] < len(got)


def test_activity_and_days_are_kept(frame, slices):
    rows = [(str(i), "queued", T0 + timedelta(minutes=7 * i), f"v{i % 9}") for i in range(440)]
    jobs = frame(rows, "id string, status string, created_at timestamp, visitor_id string")
    stream, feed = slices(jobs, "created_at", 2)
    folders = new_folder(), new_folder()
    for part in range(2):
        feed(part, part + 1)
        kept = activity.keep_activity(stream, folders[0])
        days = visits.keep_days(stream.select("visitor_id", "created_at"), folders[1])
        kept.query.awaitTermination()
        days.query.awaitTermination()
    assert rows_of(kept.rows()) == rows_of(activity.activity_windows(jobs))
    expected = jobs.groupBy(F.date_trunc("day", "created_at").alias("bucket")).agg(F.countDistinct("visitor_id").alias("v"))
    assert rows_of(visits.trend_of(days.rows(), "daily", False)) == rows_of(expected)


# ---- event folders -------------------------------------------------------------------------

JOBS = "id string, status string, progress int, error_code string"


def test_events_are_streamed_back(spark, frame):
    folder, target, state = new_folder(), new_folder(), new_folder()
    sent = []
    for batch in range(3):
        rows = [(f"{batch}-{i}", "failed", i, None if i % 2 else 'quote " and \n line') for i in range(7 * batch)]
        sent += rows
        event_feed.publish_events(frame(rows, JOBS), folder, writer="a" if batch % 2 else "b")
        events = event_feed.read_event_stream(spark, folder)
        sink = events.writeStream.format("parquet").option("path", target)
        runner.start(sink, state).awaitTermination()
        assert rows_of(spark.read.schema(events.schema).parquet(target).drop("channel")) == sorted(sent, key=repr)
    assert rows_of(event_feed.read_events(spark, folder).drop("channel")) == sorted(sent, key=repr)


def test_a_streamed_batch_that_is_committed_twice_counts_once(spark, frame):
    from foliometer.sources.event_source import EventStreamWriter

    folder = new_folder()
    writer = EventStreamWriter({"path": folder})
    for _ in range(2):
        message = writer.write(iter([("c", '{"id":"1"}'), ("c", '{"id":"2"}')]))
        writer.commit([message, None], 0)
    writer.write(iter([("c", '{"id":"3"}')]))  # never committed
    assert rows_of(event_feed.read_events(spark, folder), "id") == [("1",), ("2",)]


def test_event_folder_that_is_empty(spark):
    assert event_feed.read_events(spark, new_folder()).collect() == []


# ---- files ---------------------------------------------------------------------------------


def test_file_manifest(spark):
    folder = Path(new_folder())
    (folder / "deep" / "er").mkdir(parents=True)
    (folder / "none").mkdir()
    contents = {"a.bin": b"abc", "deep/empty": b"", "deep/er/large": b"x" * 3_000_000, "deep/er/sp ace": b"\0\xff", "over": b"y" * 3_000_001}
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    (folder / ".hidden").write_bytes(b"h")
    (folder / "_SUCCESS").write_bytes(b"")
    found = files.file_manifest(spark, str(folder), largest=3_000_000).collect()
    got = {r.path.removeprefix(f"{folder}/"): (r.size_bytes, r.checksum_sha256, r.error) for r in found}
    want = {n: (len(d), hashlib.sha256(d).hexdigest(), None) for n, d in contents.items()}
    want["over"] = (3_000_001, None, "file_too_large")
    assert got == want
    assert files.checksum(str(folder / "gone")) == (None, "unreadable")


# ---- folds and components ------------------------------------------------------------------


def test_folded_states(frame):
    for seed in range(3):
        rows = random_events(seed)
        assert rows_of(lifecycle.folded_states(frame(rows, EVENT_LOG))) == expected_states(rows)
    assert lifecycle.folded_states(frame([], EVENT_LOG)).collect() == []


def test_a_long_group_is_folded_in_pieces(spark):
    """A million events of one job: each step gets no more than an Arrow batch of them."""
    events = spark.range(1_000_000).select(
        F.when(F.col("id") % 10 == 9, F.col("id") % 50).otherwise(F.lit(-1)).alias("key"),
        (F.col("id") * 7919 % 1_000_000).alias("at"),
    )

    def step(state, columns):
        seen, last, longest = state
        ordered = all(a <= b for a, b in zip([last, *columns["at"]], columns["at"], strict=False))
        return seen + len(columns["at"]), columns["at"][-1] if ordered else 1 << 60, max(longest, len(columns["at"]))

    schema = T.StructType.fromDDL("key long, seen long, last long, longest long")
    got = folds.ordered_fold(events, ["key"], ["at"], schema, lambda key: (0, -1, 0), step, lambda key, state: [(*key, *state)])
    rows = {r.key: r for r in got.collect()}
    assert rows[-1].seen == 900_000 and rows[9].seen == 20_000
    assert all(r.last < 1_000_000 for r in rows.values())  # every piece followed the one before
    assert rows[-1].longest <= int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))


def test_fold_with_null_keys(frame):
    df = frame([(None, 2), ("a", 1), (None, 1)], "k string, v int")
    got = folds.ordered_fold(
        df, ["k"], ["v"], T.StructType.fromDDL("k string, all string"), lambda key: "",
        lambda state, columns: state + "".join(map(str, columns["v"])), lambda key, state: [(*key, state)],
    )
    assert rows_of(got) == [("a", "1"), (None, "12")]


def tree_of(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        if u is not None and v is not None:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
        else:
            root(u if u is not None else v)
    return sorted((x, root(x)) for x in parent)


def test_components(spark, frame, monkeypatch):
    calls = []
    cut = components._keep
    monkeypatch.setattr(components, "_keep", lambda df: (calls.append(df.columns), cut(df))[1])
    rng = random.Random(6)
    names = [f"n{i:05d}" for i in range(1000)]
    rng.shuffle(names)
    chain = list(zip(names, names[1:], strict=False))
    star = [("zz hub", f"leaf{i}") for i in range(500)]
    loose = [(f"x{rng.randrange(200)}", f"x{rng.randrange(200)}") for _ in range(120)]
    links = chain + star + loose + [("alone", None), (None, "other"), ("same", "same")]
    rng.shuffle(links)
    got = components.components(frame(links, "u string, v string"))
    assert rows_of(got) == tree_of(links)
    assert sum(columns == ["root", "parent"] for columns in calls) <= 16  # rounds
    assert components.components(frame([], "u string, v string")).collect() == []


def submissions(rng, n, people, addresses, days):
    return [
        (str(i), rng.choice([None, *people]), rng.choice([None, "", *addresses]),
         T0 + timedelta(seconds=rng.randrange(days * 86_400)))
        for i in range(n)
    ]


def verdicts(rows, limit):
    taken, out = [], []
    for row in sorted(rows, key=lambda r: (r[3], r[0])):
        email = row[1].strip().lower() if row[1] else None
        near = [
            t for t in taken
            if t[2] >= row[3] - timedelta(days=1) and ((email and t[0] == email) or (row[2] and t[1] == row[2]))
        ]
        accepted = len(near) < limit
        if accepted:
            taken.append((email, row[2], row[3]))
        out.append((row[0], accepted))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("limit", "component_rows"), [(1, 40), (2, 40), (3, 50_000)])
def test_daily_limit_in_folds_and_rounds(frame, limit, component_rows):
    """Some components are folded and some settled in rounds; one holds a third of all rows."""
    rng = random.Random(limit * 100 + component_rows)
    rows = submissions(rng, 60, ["hot@x"], ["9.9.9.9"], 2)
    rows += [(f"s{i}", *r[1:]) for i, r in enumerate(submissions(rng, 150, [f"P{i}@x " for i in range(40)], [f"1.{i}" for i in range(60)], 30))]
    df = frame(rows, "id string, email string, client_ip string, created_at timestamp")
    got = limits.daily_limit(df, limit, component_rows)
    assert rows_of(got, "id", "accepted") == verdicts(rows, limit)
    assert limits.daily_limit(df.limit(0), limit, component_rows).collect() == []
