"""Dashboard figures on rows small enough to count by hand."""

from __future__ import annotations

from datetime import datetime, timedelta

from conftest import rows_of
from foliometer.functions import filters
from foliometer.operators import dashboard, tools, traffic

VISITS = (
    "id string, visitor_id string, session_id string, path string, device string, browser string,"
    "os string, country string, source string, is_returning boolean, created_at timestamp"
)
NOW = "2024-03-31 10:00:00"


def visit(i, visitor, day, browser="Chrome", returning=False, device="Desktop"):
    at = datetime(2024, 3, 31) - timedelta(days=day) + timedelta(hours=9)
    return (str(i), visitor, f"{visitor}-{day}", "/", device, browser, "Linux", "DE", "Direct",
            returning, at)


def test_kpis_and_approximation_agree(frame):
    rows = [visit(1, "a", 0), visit(2, "a", 0, returning=True), visit(3, "b", 1), visit(4, "c", 99)]
    visits = frame(rows, VISITS)
    exact = traffic.traffic_kpis(visits, {}, NOW).first()
    assert tuple(exact) == (3, 2, 2, 1, 2)
    assert tuple(traffic.traffic_kpis(visits, {}, NOW, approx=True).first()) == (3, 2, 2, 1, 2)
    assert tuple(traffic.traffic_kpis(visits.limit(0), {}, NOW).first()) == (0, 0, 0, 0, 0)


def test_null_group_takes_a_place_and_is_dropped(frame):
    browsers = [None, None, None, "A", "A", "B"]
    visits = frame([visit(i, f"v{i}", 0, b) for i, b in enumerate(browsers)], VISITS)
    ranked = traffic.dimension_ranking(visits, {}, NOW, k=2, dimensions=("browser",))
    assert rows_of(ranked, "name", "count", "rank") == [("A", 2, 2)]


def test_ranking_ignores_input_order(frame):
    rows = [visit(i, f"v{i}", 0, b) for i, b in enumerate("CABDBACD")]
    for order in (rows, rows[::-1]):
        ranked = traffic.dimension_ranking(frame(order, VISITS), {}, NOW, 3, ("browser",))
        assert rows_of(ranked, "name") == [("A",), ("B",), ("C",)]


def test_period_comparison(frame):
    rows = [visit(1, "a", 0), visit(2, "b", 0), visit(3, "a", 1), visit(4, "c", 6),
            visit(5, "a", 13), visit(6, "d", 40), visit(7, "e", 59), visit(8, "f", 60)]
    got = {r.period: (r.value, r.previous, r.growth_pct) for r in traffic.period_comparison(
        frame(rows, VISITS), {"start": "2020-01-01"}, NOW).collect()}
    assert got == {"today": (2, 1, 100.0), "week": (3, 1, 200.0), "month": (3, 2, 50.0)}


def test_trend_counts_visitors_only_when_unique(frame):
    rows = [visit(1, "a", 0), visit(2, "a", 0), visit(3, "b", 1)]
    visits = frame(rows, VISITS)
    assert rows_of(traffic.trend(visits, {}, NOW), "m", "v") == [("Mar 30", 1), ("Mar 31", 2)]
    unique = traffic.trend(visits, {"visitor_type": "unique", "group_by": "monthly"}, NOW)
    assert rows_of(unique, "m", "v") == [("Mar 2024", 2)]


def test_dates_fall_back_silently():
    from datetime import date

    assert filters.date_bounds("x", "2024-02-30", NOW) == (date(2024, 3, 1), date(2024, 3, 31))
    assert filters.date_bounds("2024-01-01", None, NOW) == (date(2024, 1, 1), date(2024, 3, 31))


def test_search_wildcards_and_escapes(frame):
    df = frame([("a_b",), ("axb",), ("50% off",), ("c\\d",), (None,)], "s string")
    assert len(rows_of(filters.search(df, ["s"], "A_B"))) == 2
    assert rows_of(filters.search(df, ["s"], "a\\_b")) == [("a_b",)]
    assert rows_of(filters.search(df, ["s"], "c\\\\d")) == [("c\\d",)]
    assert len(rows_of(filters.search(df, ["s"], "c\\d"))) == 0
    assert len(rows_of(filters.search(df, ["s"], ""))) == 5


def test_conditional_filters(frame):
    df = frame([(True, "x"), (False, None)], "is_read boolean, plan string")
    assert filters.unread_only(df, False).count() == 2
    assert filters.unread_only(df, True).count() == 1
    assert filters.paying(df).count() == 1
    assert filters.optional_equals(df, plan="").count() == 2


def test_expiry_is_strict(frame):
    at = datetime(2024, 3, 31, 10)
    df = frame([("active", at, None), ("active", None, None), ("deleted", at, None)],
               "status string, expires_at timestamp, user_id string")
    assert df.filter(filters.expired_file(NOW)).count() == 0
    assert df.filter(filters.expired_file("2024-03-31 10:00:01")).count() == 1
    assert df.filter(filters.downloadable(NOW, None)).count() == 2
    assert df.filter(filters.downloadable("2024-03-31 10:00:01", None)).count() == 1
    assert df.filter(filters.downloadable(NOW, "u")).count() == 0


JOBS = "id string, tool string, status string, user_id string, created_at timestamp"


def jobs_of(frame, *tool_status):
    at = datetime(2024, 3, 30)
    return frame([(str(i), t, s, "u", at) for i, (t, s) in enumerate(tool_status)], JOBS)


def scorecard(frame, jobs, configs):
    links = frame([("0", "f1", "input"), ("0", "gone", "input"), ("0", "f1", "output")],
                  "job_id string, file_id string, role string")
    files = frame([("f1", 10)], "id string, size_bytes bigint")
    rows = [(slug, slug.upper(), "c", i) for i, slug in enumerate(configs)]
    tool_configs = frame(rows, "slug string, name string, category string, sort_order int")
    return tools.tool_scorecard(jobs, links, files, tool_configs, {}, NOW)


def test_scorecard(frame):
    jobs = jobs_of(frame, ("a", "completed"), ("a", "failed"), ("a", "queued"), ("x", "completed"))
    got = {r.slug: r for r in scorecard(frame, jobs, ["a", "b"]).collect()}
    assert (got["a"].usage_count, got["a"].success_rate) == (3, 33.3)
    assert (got["a"].files_processed, got["a"].data_processed_bytes) == (1, 10)
    assert (got["b"].usage_count, got["b"].success_rate) == (0, 100.0)
    assert set(got) == {"a", "b"}


def test_extremes(frame):
    tied = jobs_of(frame, ("b", "failed"), ("a", "failed"), ("c", "failed"))
    assert tuple(tools.tool_extremes(scorecard(frame, tied, ["c", "b", "a", "z"])).first()) == (
        "C", "A")
    unused = jobs_of(frame, ("x", "failed"))
    assert tuple(tools.tool_extremes(scorecard(frame, unused, ["c", "b"])).first()) == ("None", "B")


def test_kpis_count_links_without_file(frame):
    jobs = jobs_of(frame, ("a", "completed"))
    links = frame([("0", "f1", "input"), ("0", "gone", "input")],
                  "job_id string, file_id string, role string")
    files = frame([("f1", 10)], "id string, size_bytes bigint")
    kpis = tools.tool_kpis(jobs, links, files, {}, NOW).first()
    assert (kpis.total_files_processed, kpis.total_data_processed_bytes) == (2, 10)


def test_health_counts_the_last_hour_inclusively(frame):
    rows = [("failed", datetime(2024, 3, 31, 9)), ("failed", datetime(2024, 3, 31, 8, 59)),
            ("pending", None)]
    got = dashboard.health(frame(rows, "status string, finished_at timestamp"), NOW).first()
    assert tuple(got) == (1, 1, "Warning")


def test_empty_tables_give_zero(frame):
    subs = frame([], "status string, price_cents int, interval string")
    assert tuple(dashboard.subscription_stats(subs).first()) == (0, 0, 0, 0.0)
    assert tuple(dashboard.page_counts(subs, 20).first()) == (0, 0)
