"""Joins, windows, limits, listings and maintenance against plain Python."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from foliometer.operators import (
    batchmap,
    enrich,
    errors,
    jobs,
    lifecycle,
    limits,
    listings,
    maintenance,
    options,
    prefix,
    uploads,
)

T0 = datetime(2024, 1, 1)


# ---- running totals -------------------------------------------------------------------


def test_running_total_with_a_hot_group_of_copies(frame):
    rng = random.Random(1)
    rows = [("hot", 1, 1)] * 400
    rows += [(rng.choice("abc"), rng.randrange(50), rng.randrange(9)) for _ in range(300)]
    rng.shuffle(rows)
    df = frame(rows, "g string, o int, v int").repartition(7)
    got = prefix.running_total(df, ["g"], ["o"], F.col("v"), "total").collect()
    assert len(got) == len(rows)
    for group in "abc":
        mine = sorted(((r.o, r.total, r.v) for r in got if r.g == group), key=lambda x: x[1])
        assert [o for o, _, _ in mine] == sorted(o for o, _, _ in mine)
        assert mine[-1][1] == sum(v for g, _, v in rows if g == group)
    assert sorted(r.total for r in got if r.g == "hot") == list(range(1, 401))


# ---- attribution ------------------------------------------------------------------------


def test_returning_within_the_same_session(frame):
    rows = [("1", "a", T0), ("2", "a", T0), ("3", "b", T0), ("0", "a", T0 + timedelta(1))]
    visits = frame(rows, "id string, visitor_id string, created_at timestamp")
    got = rows_of(enrich.mark_returning(visits), "id", "is_returning")
    assert got == [("0", True), ("1", False), ("2", True), ("3", False)]


def test_job_attribution(frame):
    visits = frame(
        [("1", "a", "s1", "Mail", T0 + timedelta(1)), ("2", "a", "s1", "Ads", T0),
         ("3", "b", "s2", "", T0)],
        "id string, visitor_id string, session_id string, source string, created_at timestamp",
    )
    rows = [("j1", "a", "s1", T0), ("j2", "a", "s2", T0 + timedelta(2)), ("j3", None, None, T0)]
    found = frame(rows, "id string, visitor_id string, session_id string, created_at timestamp")
    got = rows_of(enrich.enrich_jobs(found, visits), "id", "source", "is_returning")
    assert got == [("j1", "Ads", False), ("j2", "Direct", True), ("j3", "Direct", False)]


# ---- jobs and files ------------------------------------------------------------------------

LINKS = "job_id string, file_id string, role string, position int"


def test_nested_files_are_cut_into_parts(frame):
    rng = random.Random(2)
    rows = [("big", f"f{i % 7}", "input", rng.randrange(5)) for i in range(53)]
    rows += [("small", "f2", "input", 1), ("small", "f1", "input", 0), ("small", "f1", "output", 0)]
    files = frame([(f"f{i}", f"n{i}") for i in range(7)], "id string, original_name string")
    got = jobs.nested_files(frame(rows, LINKS), files, per_row=10).collect()
    assert max(len(r.files) for r in got) <= 10
    big = [f for r in sorted(got, key=lambda r: r.part) if r.job_id == "big" for f in r.files]
    assert [(f.position, f.file_id) for f in big] == sorted(
        (p, f) for j, f, _, p in rows if j == "big"
    )
    small = {r.role: [f.file_id for f in r.files] for r in got if r.job_id == "small"}
    assert small == {"input": ["f1", "f2"], "output": ["f1"]}


def test_display_name_falls_back_to_any_file(frame):
    rows = [("a", "f1", "output", 0), ("a", "f2", "input", 3), ("b", "f1", "output", 1),
            ("c", "gone", "input", 0), ("c", "f1", "input", 1)]
    files = frame([("f1", "one"), ("f2", "two")], "id string, original_name string")
    got = rows_of(jobs.display_names(frame(rows, LINKS), files))
    assert got == [("a", "two"), ("b", "one"), ("c", None)]


def test_owner_lookup_keeps_anonymous_rows(frame):
    df = frame([("1", None), ("2", "u"), ("3", "x")], "id string, user_id string")
    users = frame([("u", "u@x")], "id string, email string")
    got = rows_of(jobs.with_user_email(df, users))
    assert got == [("1", None, None), ("2", "u", "u@x"), ("3", "x", None)]


def test_get_many(frame):
    requests = frame([("r", ["b", "zz", "a", "b"])], "request_id string, ids array<string>")
    files = frame([("a", 1), ("b", 2)], "id string, size int")
    got = rows_of(jobs.get_many(requests, files), "pos", "id")
    assert got == [(0, "b"), (2, "a"), (3, "b")]


def test_admission_reports_the_first_failed_rule(frame):
    mb = 1024 * 1024
    files = frame(
        [("ok", "u", "active", "pdf", 30 * mb), ("anon", None, "active", "pdf", 1),
         ("old", "u", "expired", "pdf", 1), ("exe", "u", "active", "exe", 1),
         ("huge", "u", "active", "pdf", 60 * mb)],
        "id string, user_id string, status string, extension string, size_bytes bigint",
    )
    cases = {
        "fine": (["ok"], None),
        "none": ([], "file_count"),
        "many": (["ok"] * 4, "file_count"),
        "anon": (["anon"], "not_found"),
        "missing": (["exe", "nowhere"], "unsupported_type"),
        "old": (["old", "exe"], "not_found"),
        "huge": (["ok", "huge", "exe"], "file_too_large"),
        "sum": (["ok", "ok"], "total_too_large"),
    }
    requests = frame([(n, "merge", "u", "free") for n in cases],
                     "request_id string, tool string, user_id string, plan string")
    links = frame([(n, i, f) for n, (ids, _) in cases.items() for i, f in enumerate(ids)],
                  "request_id string, position int, file_id string")
    profile = frame([("merge", 1, 3, ["pdf"])],
                    "tool string, min_files int, max_files int, extensions array<string>")
    got = {r.request_id: r.reason for r in jobs.admit_jobs(requests, links, files, profile).collect()}
    assert got == {name: reason for name, (_, reason) in cases.items()}


def test_option_errors(frame):
    cases = [
        ("rotate", {"angle": "45", "pages": "1,3-5"}, ["angle_choice"]),
        ("rotate", {}, []),
        ("split", {"mode": "every_page"}, []),
        ("split", {}, ["ranges_required"]),
        ("split", {"ranges": '["1-2","x"]'}, ["ranges_pattern"]),
        ("delete-pages", {}, ["pages_required"]),
        ("reorder", {"order": "[3,1,2]"}, []),
        ("reorder", {"order": "[]"}, ["order_required"]),
        ("metadata", {"title": ""}, ["field_required"]),
        ("metadata", {"clear_existing": "true"}, []),
        ("metadata", {"title": "x" * 256}, ["title_length"]),
        ("redact", {"texts": '["  "]'}, ["target_required"]),
        ("redact", {"areas": '[{"page":0,"x0":1,"y0":0,"x1":1,"y1":2,"mode":"fog"}]'},
         ["area_size", "area_range", "area_mode"]),
        ("redact", {"areas": '[{"page":1,"x0":1,"y0":0,"x1":2,"y1":2,"opacity":0.01}]'},
         ["area_opacity"]),
        ("header-footer", {"pages": "custom", "font_size": "99", "color": "red"},
         ["font_size_range", "color_pattern", "text_required", "page_range_required"]),
        ("header-footer", {"footer_text": "{page}", "font_size": "10"}, []),
        ("page-numbers", {"format": "x", "start_at": "0"}, ["start_at_range", "format_page"]),
        ("page-numbers", {}, []),
        ("fill-forms", {"fields": "{}"}, ["fields_required"]),
        ("sign", {"scale": "0.9"}, ["scale_range"]),
        ("merge", {"anything": "goes"}, []),
    ]
    rows = [(i, tool, opts) for i, (tool, opts, _) in enumerate(cases)]
    df = options.validate_options(frame(rows, "i int, tool string, options map<string,string>"))
    for row in df.collect():
        assert sorted(row.errors) == sorted(cases[row.i][2]), cases[row.i]
        assert row.valid == (not cases[row.i][2])


# ---- uploads and limits ----------------------------------------------------------------------


def test_upload_batches(frame):
    mb = 1024 * 1024
    pdf = b"%PDF-1"
    rows = [("ok", 0, "a.pdf", pdf, 30 * mb, None), ("ok", 1, "b.pdf", pdf, 20 * mb, None)]
    rows += [("sum", 0, "a.pdf", pdf, 30 * mb, None), ("sum", 1, "b.pdf", pdf, 21 * mb, None)]
    rows += [("file", 0, "a.pdf", pdf, 51 * mb, None)]
    rows += [("type", 0, "a.pdf", b"MZ", 1, None), ("type", 1, "b.pdf", pdf, 99 * mb, None)]
    rows += [("many", i, "a.pdf", pdf, 1, "free") for i in range(21)]
    rows += [("basic", i, "a.pdf", pdf, 1, "Basic") for i in range(21)]
    schema = "batch_id string, position int, filename string, head binary, size_bytes bigint, plan string"
    got = rows_of(uploads.validate_uploads(frame(rows, schema)), "batch_id", "reason", "failed_position")
    assert got == [
        ("basic", None, None), ("file", "file_limit", 0), ("many", "too_many_files", None),
        ("ok", None, None), ("sum", "combined_limit", 1), ("type", "corrupted", 0),
    ]


def test_rate_limit(frame):
    at = [0, 10, 20, 59, 60]
    rows = [(i, "upload", "ip", T0 + timedelta(seconds=s)) for i, s in enumerate(at)]
    requests = frame(rows, "id int, bucket string, client_ip string, ts timestamp")
    got = rows_of(limits.rate_limit(requests, 3), "id", "rejected")
    assert got == [(0, False), (1, False), (2, False), (3, True), (4, False)]
    assert limits.rate_limit(requests, 0).filter("rejected").count() == 0


def sequential_limit(rows, limit):
    accepted = []
    for row in sorted(rows, key=lambda r: (r[3], r[0])):
        recent = [
            a for a in accepted
            if a[3] >= row[3] - timedelta(days=1)
            and (a[1].strip().lower() == row[1].strip().lower() or (row[2] and a[2] == row[2]))
        ]
        if len(recent) < limit:
            accepted.append(row)
    return sorted(a[0] for a in accepted)


@pytest.mark.parametrize(
    ("limit", "component_rows", "n"), [(1, 0, 120), (2, 0, 40), (1, 60, 120), (3, 1000, 200)]
)
def test_daily_limit_equals_one_by_one(frame, monkeypatch, limit, component_rows, n):
    monkeypatch.setattr(limits, "MAX_ROUND_FRAMES", 3)
    rng = random.Random(limit)
    rows = [
        (f"s{i:03d}", rng.choice([" A@x ", "a@X", "b@x", "c@x", f"u{i}@x"]),
         rng.choice(["1", "2", None, "", f"ip{i % 30}"]),
         T0 + timedelta(minutes=rng.randrange(4 * 1440)))
        for i in range(n)
    ]
    df = frame(rows, "id string, email string, client_ip string, created_at timestamp")
    got = limits.daily_limit(df, limit, component_rows)
    assert got.count() == len(rows)
    assert sorted(r.id for r in got.filter("accepted").collect()) == sequential_limit(rows, limit)


@pytest.mark.parametrize("limit", [1, 3])
def test_daily_limit_drops_repeats_of_an_instant_before_it_counts_components(frame, monkeypatch, limit):
    rng = random.Random(limit)
    rows = [
        (f"{i:04d}", rng.choice(["a@x", "b@x", None]), rng.choice(["1", "2", None]), T0 + timedelta(hours=8 * rng.randrange(4)))
        for i in range(600)
    ]
    df = frame(rows, "id string, email string, client_ip string, created_at timestamp")
    monkeypatch.setattr(limits, "_settle_in_rounds", lambda *_: pytest.fail("settled in rounds"))
    got = limits.daily_limit(df, limit, 8 * 4 * limit)
    expected, taken = set(), []
    for name, email, ip, at in sorted(rows, key=lambda row: (row[3], row[0])):
        since = at - timedelta(days=1)
        near = [t for t in taken if t[2] >= since and ((email and t[0] == email) or (ip and t[1] == ip))]
        if len(near) < limit:
            expected.add(name)
            taken.append((email, ip, at))
    assert {row.id for row in got.filter("accepted").collect()} == expected
    assert got.count() == len(rows)


def test_daily_limit_can_be_switched_off(frame):
    df = frame([("1", "a", "b", T0)] * 2, "id string, email string, client_ip string, created_at timestamp")
    assert limits.daily_limit(df, 0).filter("accepted").count() == 2


# ---- error log ---------------------------------------------------------------------------------

EVENTS = ("id string, exc_type string, file string, function string, message string, path string,"
          "stack string, ts timestamp")  # fmt: skip


def test_errors_reopen_and_keep_their_origin(frame):
    first = frame([("1", "E", "a", "f", "m1", "/1", "s1", T0)], EVENTS)
    later = frame([("2", "E", "a", "f", "m" * 600, "/2", "s2", T0 + timedelta(1))], EVENTS)
    log = errors.collapse_errors(first).withColumn("resolved", F.lit(True))
    row = errors.merge_errors(log, errors.collapse_errors(later)).first()
    assert (row["count"], row.path, row.stack, row.resolved) == (2, "/1", "s1", False)
    assert len(row.message) == 500
    assert (row.created_at, row.last_seen_at) == (T0, T0 + timedelta(1))


# ---- job lifecycle --------------------------------------------------------------------------------


def folded_state(events):
    status, progress, code, before = "pending", 0, None, None
    for _, kind, _, _, value, error in events:
        finished = status in ("completed", "failed", "cancelled", "expired")
        if kind == "retry":
            status, progress, code = "queued", 0, None
        elif kind == "expire":
            if finished and status != "expired":
                before, status = status, "expired"
        elif finished:
            continue
        elif kind == "progress":
            progress = max(0, min(100, value))
        else:
            status = kind
            progress = {"processing": 0, "completed": 100}.get(kind, progress)
            code = error if kind == "failed" else None
    return status, progress, code if "failed" in (status, before) else None


def random_events(seed, n_jobs=40, n=12):
    rng = random.Random(seed)
    kinds = ["queued", "processing", "progress", "progress", "completed", "failed", "cancelled",
             "retry", "expire"]
    rows = []
    for job in range(n_jobs):
        for seq in range(rng.randrange(1, n)):
            kind = rng.choice(kinds)
            at = T0 + timedelta(seconds=seq // 2)
            rows.append((f"j{job}", kind, at, seq, rng.randrange(-20, 140),
                         "E1" if kind == "failed" else None))
    return rows


EVENT_LOG = "job_id string, kind string, ts timestamp, seq bigint, progress int, error_code string"


def expected_states(rows):
    per_job = {}
    for row in sorted(rows, key=lambda r: (r[2], r[3])):
        per_job.setdefault(row[0], []).append(row)
    found = []
    for job, events in per_job.items():
        status, progress, code = folded_state(events)
        found.append((job, status, progress, code))
    return sorted(found, key=repr)


def test_job_states_equal_a_fold(frame):
    rows = random_events(3)
    shuffled = random.Random(4).sample(rows, len(rows))
    got = rows_of(lifecycle.job_states(frame(shuffled, EVENT_LOG)))
    assert got == expected_states(rows)


def test_event_feed_stops_at_the_end_and_at_the_cap(frame):
    rows = [("a", k, T0, i, 0, None) for i, k in enumerate(["queued", "progress", "failed", "retry"])]
    rows += [("b", "progress", T0, i, 0, None) for i in range(9)]
    feed = lifecycle.event_feed(frame(rows, EVENT_LOG), cap=5)
    assert rows_of(feed.groupBy("job_id").count()) == [("a", 3), ("b", 5)]


# ---- listings -----------------------------------------------------------------------------------------


def test_null_and_enum_order(frame):
    rows = [("1", None, "failed"), ("2", T0, "pending"), ("3", T0 + timedelta(1), "completed")]
    df = frame(rows, "id string, renews_at timestamp, status string")

    def ids(name, sort):
        order = listings.sort_columns(listings.LISTINGS[name], sort)
        return [r.id for r in df.withColumn("created_at", F.lit(T0)).orderBy(*order).collect()]

    assert ids("subscriptions", "renews_at") == ["2", "3", "1"]
    assert ids("subscriptions", "-renews_at") == ["1", "3", "2"]
    assert ids("jobs", "status") == ["2", "3", "1"]
    assert ids("jobs", "drop table") == ["1", "2", "3"]


def test_pages(frame):
    df = frame([(f"{i:02d}", "x") for i in range(45)], "id string, tool string")
    df = df.withColumn("created_at", F.lit(T0)).withColumn("status", F.lit("queued"))
    page, total = listings.listing(df, "jobs", page=3, size=20)
    assert [r.id for r in page.collect()] == ["40", "41", "42", "43", "44"]
    assert tuple(total.first()) == (45, 3)
    with pytest.raises(ValueError, match="size"):
        listings.listing(df, "jobs", size=101)


# ---- maintenance ---------------------------------------------------------------------------------------


def test_bulk_users(frame):
    users = frame([("1", "active"), ("2", "suspended"), ("3", "active")], "id string, status string")
    ids = frame([("1",), ("1",), ("2",), ("9",)], "id string")
    suspended = rows_of(maintenance.bulk_users(users, ids, "suspend"))
    assert suspended == [("1", "suspended", True), ("2", "suspended", False), ("3", "active", False)]
    assert rows_of(maintenance.bulk_users(users, ids, "delete"), "id") == [("3",)]
    with pytest.raises(ValueError, match="delete, suspend or activate"):
        maintenance.bulk_users(users, ids, "promote")


def test_patches_apply_in_order(frame):
    users = frame([("1", "free", "A"), ("2", "pro", "B")], "id string, plan string, name string")
    patches = frame([("1", 1, "pro", None), ("1", 2, None, "C"), ("1", 3, "basic", None)],
                    "id string, at int, plan string, name string")
    assert rows_of(maintenance.patch(users, patches, "id", "at")) == [
        ("1", "basic", "C"), ("2", "pro", "B")]


def test_cancel_and_retry(frame):
    jobs_in = frame(
        [("1", "queued", 40, None, None), ("2", "failed", 70, "E", T0), ("3", "queued", 5, None, None)],
        "id string, status string, progress int, error_code string, finished_at timestamp",
    )
    ids = frame([("1",), ("2",)], "id string")
    cancelled = rows_of(maintenance.cancel_jobs(jobs_in, ids, T0), "id", "status", "rejected")
    assert cancelled == [("1", "cancelled", False), ("2", "failed", True), ("3", "queued", False)]
    retried = rows_of(maintenance.retry_jobs(jobs_in, ids), "id", "status", "progress", "error_code")
    assert retried == [("1", "queued", 0, None), ("2", "queued", 0, None), ("3", "queued", 5, None)]


def test_registration(frame):
    schema = "id string, name string, email string, created_at timestamp"
    candidates = frame([("1", " A ", "X@y ", T0 + timedelta(1)), ("2", "B", "x@Y", T0),
                        ("3", "C", "taken@y", T0)], schema)
    users = frame([("Taken@Y",)], "email string")
    assert rows_of(maintenance.register_users(candidates, users), "id", "email") == [("2", "x@y")]


def test_settings_overlay(frame):
    def merged(base, override):
        b = frame([("k", json.dumps(base))], "key string, value string")
        o = frame([("k", json.dumps(override))], "key string, value string")
        return json.loads(maintenance.overlay_settings(b, o).first().value)

    assert merged({"a": {"b": 1, "c": 2}, "l": [1, 2]}, {"a": {"c": 3}, "l": []}) == {
        "a": {"b": 1, "c": 3}, "l": []}
    assert merged({"a": {"b": 1}}, {"a": {}}) == {"a": {"b": 1}}
    assert merged({"a": {"b": 1}}, {"a": None}) == {"a": None}
    assert merged({"a": 1}, {"a": {"b": {}}}) == {"a": {"b": {}}}
    assert merged({"a": {"b": 1}}, {"a": "{}"}) == {"a": "{}"}
    assert merged({"a": {"b": {"c": [{"d": 1}]}}}, {"a": {"b": {"c": [], "e": None}}}) == {
        "a": {"b": {"c": [], "e": None}}}


def test_overlay_of_forty_levels(frame):
    base, override, expected = {"x": 1}, {"y": '}{"\\'}, {"x": 1, "y": '}{"\\'}
    for level in range(39):
        base = {"n": base, "l": [level]}
        override = {"n": override, "r": '"{['}
        expected = {"n": expected, "l": [level], "r": '"{['}
    schema = "key string, value string"
    b, o = frame([("k", json.dumps(base))], schema), frame([("k", json.dumps(override))], schema)
    assert json.loads(maintenance.overlay_settings(b, o).first().value) == expected
    deeper = frame([("k", json.dumps({"n": base}))], schema)
    above = frame([("k", json.dumps({"n": override}))], schema)
    with pytest.raises(ValueError):
        maintenance.overlay_settings(deeper, above)
    assert maintenance.overlay_settings(b.limit(0), o.limit(0)).isEmpty()


def test_overlay_of_missing_sides(frame):
    base = frame([("a", '{"x": 1}')], "key string, value string")
    override = frame([("b", '{"y": 2}')], "key string, value string")
    assert rows_of(maintenance.overlay_settings(base, override)) == [
        ("a", '{"x": 1}'), ("b", '{"y": 2}')]


# ---- per-file functions ------------------------------------------------------------------------------------


def test_batch_map_turns_errors_into_rows(frame):
    def work(content, name, position):
        if name == "bad":
            raise batchmap.FileError("CODE", "no")
        if name == "crash":
            raise KeyError("x")
        return [] if name == "none" else [content, content]

    files = frame([("j", 0, "good", b"a"), ("j", 2, "bad", b"b"), ("j", 1, "crash", b"c"),
                   ("k", 0, "none", b"d"), ("k", 1, "good", b"e")],
                  "job_id string, position int, name string, content binary")
    results = batchmap.batch_map(files, work)
    assert results.count() == 6
    outcomes = rows_of(batchmap.job_outcomes(results), "job_id", "status", "error_code", "outputs")
    assert outcomes == [("j", "failed", "INTERNAL_SERVER_ERROR", 2), ("k", "completed", None, 2)]


def test_batch_function_of_sql_has_the_rows_of_batch_map(spark, frame):
    def work(content, name, position):
        if name is None:
            raise batchmap.FileError("CODE", "no name")
        return [content] * position

    files = frame([("j", 2, "a", b"a", 1), ("j", 0, "b", b"", 2), ("j", 1, None, b"c", 3), ("k", 1, "x", None, 4)],
                  "job_id string, position int, name string, content binary, more int")
    batchmap.register_batch_function(spark, "repeat_file", work)
    files.createOrReplaceTempView("files_to_repeat")
    found = spark.sql("SELECT * FROM repeat_file(TABLE(SELECT more, content, name, position, job_id FROM files_to_repeat))")
    plain = batchmap.batch_map(files, work)
    assert found.schema == plain.schema
    assert sorted(found.collect(), key=repr) == sorted(plain.collect(), key=repr)
    assert spark.sql("SELECT * FROM repeat_file(TABLE(SELECT * FROM files_to_repeat WHERE more > 9))").isEmpty()


def test_a_lowered_hot_key_limit_changes_no_verdict(spark, frame):
    rows = [("b", n, "a.exe", bytearray(b"xx"), 2, "pro") for n in range(60)]
    items = frame(rows, "batch_id string, position int, filename string, head binary, size_bytes long, plan string")
    usual = rows_of(uploads.validate_uploads(items))
    spark.conf.set("spark.foliometer.hotRows", "10")
    try:
        assert rows_of(uploads.validate_uploads(items)) == usual
    finally:
        spark.conf.unset("spark.foliometer.hotRows")
    assert usual[0][2] is False
