"""Traffic, tool and overview figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboard, jobs, tools, traffic
from .registry import query
from .testdata import EVENTS_NOW, FILES_NOW, ORDERS_NOW

MONTH = {"start": "2024-01-01", "end": "2024-01-30"}
YEARS = {"start": "1998-01-01", "end": "2000-12-31"}
IN_MONTH = "created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-31'"
IN_YEARS = "created_at >= TIMESTAMP '1998-01-01' AND created_at < TIMESTAMP '2001-01-01'"


@query(
    "A1_overview",
    "total_users:i active_users:i total_conversions:i today_conversions:i total_subscribers:i "
    "monthly_revenue_cents:i storage_bytes:i failed_jobs:i total_feedback:i",
    "processing_jobs stored_files users subscriptions feedback",
    """SELECT (SELECT count(*) FROM users) AS total_users,
    (SELECT count(DISTINCT user_id) FROM processing_jobs) AS active_users,
    (SELECT count(*) FROM processing_jobs) AS total_conversions,
    (SELECT count(*) FROM processing_jobs WHERE created_at >= TIMESTAMP '2001-08-01')
      AS today_conversions,
    (SELECT count(*) FROM subscriptions WHERE status = 'active') AS total_subscribers,
    (SELECT coalesce(sum(price_cents), 0) FROM subscriptions WHERE status = 'active')
      AS monthly_revenue_cents,
    (SELECT coalesce(sum(size_bytes), 0) FROM stored_files WHERE status = 'active')
      AS storage_bytes,
    (SELECT count(*) FROM processing_jobs WHERE status = 'failed') AS failed_jobs,
    (SELECT count(*) FROM feedback) AS total_feedback""",
)
def _overview(t):
    return dashboard.overview(
        t.users, t.processing_jobs, t.subscriptions, t.stored_files, t.feedback,
        "2001-08-01 15:00:00",
    )


@query(
    "A2_traffic_kpis",
    "page_views:i total_visitors:i unique_visitors:i returning_visitors:i total_sessions:i",
    "page_visits",
    f"""SELECT count(*) AS page_views, count(DISTINCT visitor_id) AS total_visitors,
    count(DISTINCT CASE WHEN NOT is_returning THEN visitor_id END) AS unique_visitors,
    count(DISTINCT CASE WHEN is_returning THEN visitor_id END) AS returning_visitors,
    count(DISTINCT session_id) AS total_sessions FROM page_visits WHERE {IN_MONTH}""",
)
def _traffic_kpis(t):
    return traffic.traffic_kpis(t.page_visits, MONTH, EVENTS_NOW)


_DISTINCT = "count(DISTINCT CASE WHEN created_at >= TIMESTAMP '{}' AND created_at < TIMESTAMP '{}' "
_COMPARE = " UNION ALL ".join(
    f"SELECT '{period}' AS period, {_DISTINCT.format(middle, end)} THEN visitor_id END) AS value, "
    f"{_DISTINCT.format(start, middle)} THEN visitor_id END) AS previous FROM page_visits"
    for period, start, middle, end in (
        ("today", "2024-01-28", "2024-01-29", "2024-01-30"),
        ("week", "2024-01-16", "2024-01-23", "2024-01-30"),
        ("month", "2023-12-01", "2023-12-31", "2024-01-30"),
    )
)


@query(
    "A3_period_comparison",
    "period:s value:i previous:i growth_pct:f",
    "page_visits",
    f"""SELECT period, value, previous, CASE WHEN previous = 0 THEN 0.0
    ELSE round((value - previous) / previous * 100, 1) END AS growth_pct FROM ({_COMPARE})""",
)
def _period_comparison(t):
    return traffic.period_comparison(t.page_visits, {}, "2024-01-29 12:00:00")


@query(
    "A3_period_comparison_filtered",
    "period:s value:i previous:i growth_pct:f",
    "page_visits",
    f"""SELECT period, value, previous, CASE WHEN previous = 0 THEN 0.0
    ELSE round((value - previous) / previous * 100, 1) END AS growth_pct FROM (
    {_COMPARE.replace("FROM page_visits", "FROM page_visits WHERE is_returning AND device = 'Mobile'")})""",  # noqa: E501
)
def _period_comparison_filtered(t):
    params = {"device": "MOBILE", "visitor_type": "returning"}
    return traffic.period_comparison(t.page_visits, params, "2024-01-29 12:00:00")


def _trend_sql(unit: str, label: str, value: str, table: str, where: str) -> str:
    return f"""SELECT bucket, {label} AS m, v FROM (
    SELECT CAST(date_trunc('{unit}', created_at) AS TIMESTAMP) AS bucket, {value} AS v
    FROM {table} WHERE {where} GROUP BY 1)"""


WEEK_LABEL = "concat('Wk ', week(bucket), ' (', year(bucket), ')')"
DAY_LABEL, MONTH_LABEL = "strftime(bucket, '%b %d')", "strftime(bucket, '%b %Y')"
ONE_DISTINCT = "count(DISTINCT visitor_id)"
for _name, _params, _sql in (
    ("daily", {}, _trend_sql("day", DAY_LABEL, "count(*)", "page_visits", IN_MONTH)),
    ("weekly", {"group_by": "weekly"},
     _trend_sql("week", WEEK_LABEL, "count(*)", "page_visits", IN_MONTH)),
    ("monthly_unique", {"group_by": "monthly", "visitor_type": "unique"},
     _trend_sql("month", MONTH_LABEL, ONE_DISTINCT, "page_visits",
                IN_MONTH + " AND NOT is_returning")),
    ("daily_unique", {"visitor_type": "unique"},
     _trend_sql("day", DAY_LABEL, ONE_DISTINCT, "page_visits", IN_MONTH + " AND NOT is_returning")),
):
    query(f"A4_traffic_trend_{_name}", "bucket:t m:s v:i", "page_visits", _sql)(
        lambda t, params=_params: traffic.trend(t.page_visits, {**MONTH, **params}, EVENTS_NOW)
    )

_RANKED = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS name, count(*) AS count FROM page_visits "
    f"WHERE {IN_MONTH} GROUP BY {d}"
    for d in ("path", "browser", "device", "os", "country", "source")
)


@query(
    "A5_dimension_ranking",
    "dimension:s name:s count:i rank:i",
    "page_visits",
    f"""SELECT dimension, name, count, rank FROM (SELECT *, row_number() OVER (
    PARTITION BY dimension ORDER BY count DESC, name ASC NULLS LAST) AS rank FROM ({_RANKED}))
    WHERE rank <= 3 AND name IS NOT NULL""",
)
def _dimension_ranking(t):
    return traffic.dimension_ranking(t.page_visits, MONTH, EVENTS_NOW, k=3)


@query(
    "A6_top_tools",
    "tool:s count:i",
    "processing_jobs",
    f"""SELECT tool, count(*) AS count FROM processing_jobs WHERE {IN_YEARS} AND is_returning
    GROUP BY tool ORDER BY count DESC, tool LIMIT 3""",
)
def _top_tools(t):
    params = {**YEARS, "visitor_type": "returning"}
    return traffic.top_tools(t.processing_jobs, params, ORDERS_NOW, k=3)


TOOL_VIEWS = "processing_jobs job_files stored_files"
TOOL_COUNTS = f"""counts AS (SELECT tool, count(*) AS total,
      sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS success,
      sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS failed
    FROM processing_jobs WHERE {IN_YEARS} GROUP BY tool)"""
TOOL_FILES = f"""processed AS (SELECT j.tool, count(*) AS links, count(f.id) AS files,
      coalesce(sum(f.size_bytes), 0) AS bytes
    FROM job_files l JOIN processing_jobs j ON l.job_id = j.id
    LEFT JOIN stored_files f ON l.file_id = f.id
    WHERE l.role = 'input' AND {IN_YEARS.replace("created_at", "j.created_at")} GROUP BY j.tool)"""


@query(
    "A7_tool_kpis",
    "total_executions:i success_executions:i failed_executions:i total_files_processed:i "
    "total_data_processed_bytes:i",
    TOOL_VIEWS,
    f"""WITH {TOOL_COUNTS}, {TOOL_FILES}
    SELECT (SELECT sum(total) FROM counts) AS total_executions,
      (SELECT sum(success) FROM counts) AS success_executions,
      (SELECT sum(failed) FROM counts) AS failed_executions,
      (SELECT sum(links) FROM processed) AS total_files_processed,
      (SELECT sum(bytes) FROM processed) AS total_data_processed_bytes""",
)
def _tool_kpis(t):
    return tools.tool_kpis(t.processing_jobs, t.job_files, t.stored_files, YEARS, ORDERS_NOW)


@query(
    "A8_tool_counts",
    "tool:s total:i success:i failed:i",
    "processing_jobs",
    f"WITH {TOOL_COUNTS} SELECT * FROM counts",
)
def _tool_counts(t):
    return tools.tool_counts(t.processing_jobs, YEARS, ORDERS_NOW)


@query(
    "A9_tool_files",
    "tool:s files:i bytes:i",
    TOOL_VIEWS,
    f"WITH {TOOL_FILES} SELECT tool, files, bytes FROM processed",
)
def _tool_files(t):
    return tools.tool_files(t.processing_jobs, t.job_files, t.stored_files, YEARS, ORDERS_NOW)


SCORECARD = f"""{TOOL_COUNTS}, {TOOL_FILES}, scorecard AS (
    SELECT c.slug, c.name, c.category, c.sort_order, coalesce(n.total, 0) AS usage_count,
      coalesce(n.success, 0) AS success_count, coalesce(n.failed, 0) AS failure_count,
      CASE WHEN coalesce(n.total, 0) = 0 THEN 100.0
        ELSE round(100.0 * n.success / n.total, 1) END AS success_rate,
      coalesce(p.files, 0) AS files_processed, coalesce(p.bytes, 0) AS data_processed_bytes
    FROM tool_configs c LEFT JOIN counts n ON c.slug = n.tool
    LEFT JOIN processed p ON c.slug = p.tool)"""
SCORE_COLUMNS = (
    "slug:s name:s category:s sort_order:i usage_count:i success_count:i failure_count:i "
    "success_rate:f files_processed:i data_processed_bytes:i"
)


def _scorecard_of(t):
    return tools.tool_scorecard(
        t.processing_jobs, t.job_files, t.stored_files, t.tool_configs, YEARS, ORDERS_NOW
    )


for _name in ("A10_tool_scorecard", "J11_configured_tools"):
    query(
        _name, SCORE_COLUMNS, TOOL_VIEWS + " tool_configs", f"WITH {SCORECARD} SELECT * FROM scorecard"
    )(_scorecard_of)


@query(
    "A11_tool_extremes",
    "most_popular_tool:s least_used_tool:s",
    TOOL_VIEWS + " tool_configs",
    f"""WITH {SCORECARD}, used AS (SELECT name, row_number() OVER (
      ORDER BY usage_count DESC, sort_order, name) AS place FROM scorecard WHERE usage_count > 0)
    SELECT (SELECT name FROM used WHERE place = 1) AS most_popular_tool,
      (SELECT name FROM used ORDER BY place DESC LIMIT 1) AS least_used_tool""",
)
def _tool_extremes(t):
    return tools.tool_extremes(_scorecard_of(t))


@query(
    "A12_job_trend_yearly",
    "bucket:t m:s v:i",
    "processing_jobs",
    _trend_sql("year", "strftime(bucket, '%Y')", "count(*)", "processing_jobs", IN_YEARS),
)
def _job_trend(t):
    return traffic.job_trend(t.processing_jobs, {**YEARS, "group_by": "yearly"}, ORDERS_NOW)


@query(
    "A12_job_trend_weekly",
    "bucket:t m:s v:i",
    "processing_jobs",
    _trend_sql("week", WEEK_LABEL, "count(*)", "processing_jobs", IN_YEARS),
)
def _job_trend_weekly(t):
    return traffic.job_trend(t.processing_jobs, {**YEARS, "group_by": "weekly"}, ORDERS_NOW)


@query(
    "A13_monthly_conversions",
    "bucket:t m:s v:i",
    "processing_jobs",
    """SELECT CAST(date_trunc('month', created_at) AS TIMESTAMP) AS bucket,
    strftime(min(created_at), '%b') AS m, count(*) AS v FROM processing_jobs GROUP BY 1""",
)
def _monthly(t):
    return dashboard.monthly_conversions(t.processing_jobs)


@query(
    "A14_tool_usage",
    "tool:s count:i",
    "processing_jobs",
    """SELECT tool, count(*) AS count FROM processing_jobs GROUP BY tool
    ORDER BY count DESC, tool LIMIT 4""",
)
def _usage(t):
    return traffic.tool_usage(t.processing_jobs, 4)


@query(
    "A15_usage_share",
    "tool:s count:i pct:f",
    "processing_jobs",
    """WITH top AS (SELECT tool, count(*) AS count FROM processing_jobs GROUP BY tool
      ORDER BY count DESC, tool LIMIT 3)
    SELECT tool, count, round(100.0 * count / (SELECT sum(count) FROM top), 1) AS pct FROM top""",
)
def _share(t):
    return tools.usage_share(t.processing_jobs, 3)


@query(
    "A16_user_stats",
    "total:i active:i suspended:i pro:i",
    "users",
    """SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active,
    count(*) FILTER (status = 'suspended') AS suspended, count(*) FILTER (plan <> 'free') AS pro
    FROM users""",
)
def _user_stats(t):
    return dashboard.user_stats(t.users)


@query(
    "A17_subscription_stats",
    "active:i expired:i mrr_cents:i churn:f",
    "subscriptions",
    """SELECT *, CASE WHEN active + expired = 0 THEN 0.0
      ELSE round(100.0 * expired / (active + expired), 1) END AS churn FROM (
    SELECT count(*) FILTER (status = 'active') AS active,
      count(*) FILTER (status = 'expired') AS expired,
      coalesce(sum(price_cents) FILTER (status = 'active' AND billing_interval = 'monthly'), 0)
        AS mrr_cents FROM subscriptions)""",
)
def _subscription_stats(t):
    return dashboard.subscription_stats(t.subscriptions, "billing_interval")


@query(
    "A18_user_details",
    "id:i email:s conversions:i files_count:i subscription_id:i subscription_status:s",
    "users processing_jobs stored_files subscriptions",
    """SELECT u.id, u.email, coalesce(j.n, 0) AS conversions, coalesce(f.n, 0) AS files_count,
      s.id AS subscription_id, s.status AS subscription_status
    FROM users u
    LEFT JOIN (SELECT user_id, count(*) AS n FROM processing_jobs GROUP BY 1) j ON j.user_id = u.id
    LEFT JOIN (SELECT user_id, count(*) AS n FROM stored_files GROUP BY 1) f ON f.user_id = u.id
    LEFT JOIN (SELECT *, row_number() OVER (
      PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r FROM subscriptions) s
      ON s.user_id = u.id AND s.r = 1""",
)
def _user_details(t):
    details = dashboard.user_details(t.users, t.processing_jobs, t.stored_files, t.subscriptions)
    return details.select(
        "id",
        "email",
        "conversions",
        "files_count",
        F.col("subscription.id").alias("subscription_id"),
        F.col("subscription.status").alias("subscription_status"),
    )


@query(
    "A19_file_stats",
    "category:s is_total:b files:i bytes:i",
    "stored_files",
    """SELECT category, false AS is_total, count(*) AS files, sum(size_bytes) AS bytes
    FROM stored_files WHERE status = 'active' GROUP BY category UNION ALL
    SELECT NULL, true, count(*), coalesce(sum(size_bytes), 0) FROM stored_files
    WHERE status = 'active'""",
)
def _file_stats(t):
    return dashboard.file_stats(t.stored_files)


@query(
    "A20_job_stats",
    "processing:i queued:i completed:i failed:i",
    "event_jobs",
    """SELECT count(*) FILTER (status = 'processing') AS processing,
    count(*) FILTER (status IN ('queued', 'pending')) AS queued,
    count(*) FILTER (status = 'completed') AS completed,
    count(*) FILTER (status = 'failed') AS failed FROM event_jobs""",
)
def _job_stats(t):
    return dashboard.job_stats(t.event_jobs)


@query(
    "A21_feedback_stats",
    "category:s is_total:b n:i",
    "feedback",
    """SELECT category, false AS is_total, count(*) AS n FROM feedback GROUP BY category
    UNION ALL SELECT NULL, true, count(*) FROM feedback""",
)
def _feedback_stats(t):
    return dashboard.feedback_stats(t.feedback)


@query(
    "A22_unread_messages",
    "unread:i",
    "feedback",
    "SELECT count(*) AS unread FROM feedback WHERE NOT is_read",
)
def _unread(t):
    return dashboard.unread_messages(t.feedback)


@query(
    "A23_health",
    "pending_jobs:i recent_failures:i worker_status:s",
    "event_jobs",
    """SELECT *, CASE WHEN recent_failures > 0 THEN 'Warning' ELSE 'Healthy' END AS worker_status
    FROM (SELECT count(*) FILTER (status IN ('queued', 'pending')) AS pending_jobs,
      count(*) FILTER (status = 'failed' AND finished_at >= TIMESTAMP '2024-01-29 23:00:00')
        AS recent_failures FROM event_jobs)""",
)
def _health(t):
    return dashboard.health(t.event_jobs, "2024-01-30 00:00:00")


@query(
    "A24_live_activity",
    "active_jobs:i today_jobs:i",
    "event_jobs",
    """SELECT count(*) FILTER (status IN ('processing', 'queued')) AS active_jobs,
    count(*) FILTER (created_at >= TIMESTAMP '2024-01-29') AS today_jobs FROM event_jobs""",
)
def _live(t):
    return dashboard.live_activity(t.event_jobs, "2024-01-29 18:30:00")


@query(
    "A25_phase_timing",
    "job_id:i phase:s phase_ms:f calls:i",
    "",
    """SELECT user_id AS job_id, event_type AS phase, round(sum(value) * 1000, 1) AS phase_ms,
    count(*) AS calls FROM events GROUP BY 1, 2""",
)
def _phases(t):
    return dashboard.phase_timing(
        t.raw("events").select(
            F.col("user_id").alias("job_id"),
            F.col("event_type").alias("phase"),
            F.col("value").alias("seconds"),
        )
    )


@query(
    "A26_page_counts",
    "total:i pages:i",
    "processing_jobs",
    """SELECT count(*) AS total, ceil(count(*) / 30.0) AS pages FROM processing_jobs
    WHERE status = 'completed'""",
)
def _page_counts(t):
    return dashboard.page_counts(t.processing_jobs.filter("status = 'completed'"), 30)


@query(
    "A27_tool_list",
    "slug:s name:s usage:i",
    "processing_jobs tool_configs",
    """SELECT c.slug, c.name, count(j.id) AS usage FROM tool_configs c
    LEFT JOIN processing_jobs j ON j.tool = c.slug GROUP BY c.slug, c.name""",
)
def _tool_list(t):
    return tools.tool_list(t.tool_configs, t.processing_jobs)


@query(
    "A28_run_summary",
    "job_id:i input_files:i input_bytes:i output_files:i",
    "job_files stored_files",
    """SELECT l.job_id, count(*) FILTER (l.role = 'input') AS input_files,
    coalesce(sum(f.size_bytes) FILTER (l.role = 'input'), 0) AS input_bytes,
    count(*) FILTER (l.role = 'output') AS output_files
    FROM job_files l LEFT JOIN stored_files f ON l.file_id = f.id GROUP BY l.job_id""",
)
def _run_summary(t):
    return jobs.run_summary(t.job_files, t.stored_files)


@query(
    "W7_M1_retention_summary",
    "what:s n:i",
    "stored_files event_jobs",
    """SELECT 'files_removed' AS what, count(*) AS n FROM stored_files
    WHERE status = 'active' AND expires_at < TIMESTAMP '2024-01-31' UNION ALL
    SELECT 'jobs_expired', count(*) FROM event_jobs
    WHERE status IN ('completed', 'failed', 'cancelled') AND expires_at < TIMESTAMP '2024-01-31'""",
)
def _retention(t):
    from ..operators.maintenance import retention_summary

    return retention_summary(t.stored_files, t.event_jobs, None, FILES_NOW)
