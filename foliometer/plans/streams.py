"""Stateful operators in batch and their streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import errors, lifecycle, limits
from ..streaming import activity, visits
from ..streaming.errors import error_stream
from ..streaming.lifecycle import lifecycle_stream
from ..streaming.limits import offender_stream
from .registry import query
from .testdata import stream_view


def _stream(t, name: str):
    return stream_view(t.spark, t.folder, name)


_VALID = "length(path) BETWEEN 1 AND 512"


@query(
    "W1_visit_stream",
    "id:s visitor_id:s is_returning:b",
    "raw_visits",
    f"""SELECT id, visitor_id, row_number() OVER (PARTITION BY visitor_id ORDER BY created_at, id)
    > 1 AS is_returning FROM raw_visits WHERE {_VALID}""",
)
def _visit_stream(t):
    return visits.ingest_visits(_stream(t, "raw_visits"))[0]


@query(
    "S2_visit_quarantine",
    "id:s visitor_id:s",
    "raw_visits",
    f"SELECT id, visitor_id FROM raw_visits WHERE NOT ({_VALID})",
)
def _quarantine(t):
    return visits.ingest_visits(_stream(t, "raw_visits"))[1]


_WINDOWS = """SELECT bucket, client_ip, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute,
    count(*) AS requests, greatest(0, count(*) - 5) AS rejected FROM requests GROUP BY 1, 2, 3"""
_WINDOW_COLUMNS = "bucket:s client_ip:s minute:i requests:i rejected:i"
query("W2_limit_windows", _WINDOW_COLUMNS, "requests", _WINDOWS)(
    lambda t: limits.window_counts(t.requests, 5)
)
query("W2_limit_stream", _WINDOW_COLUMNS, "requests", _WINDOWS)(
    lambda t: offender_stream(_stream(t, "requests"), 5)
)


@query(
    "W3_daily_limit",
    "id:i email:s client_ip:s accepted:b",
    "feedback",
    """WITH queue AS (SELECT *, row_number() OVER (
      ORDER BY created_at, CAST(id AS VARCHAR)) AS n FROM feedback),
    step(n, taken, accepted) AS (
      SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(seen TIMESTAMP, email VARCHAR, ip VARCHAR)[]), false
      UNION ALL SELECT q.n, CASE WHEN hit THEN s.taken ELSE list_append(s.taken,
        {'seen': q.created_at, 'email': q.email, 'ip': q.client_ip}) END, NOT hit
      FROM step s JOIN queue q ON q.n = s.n + 1, LATERAL (SELECT len([x FOR x IN s.taken IF
        x.seen >= q.created_at - INTERVAL 1 DAY AND (x.email = q.email OR x.ip = q.client_ip)]) > 0
        AS hit))
    SELECT q.id, q.email, q.client_ip, s.accepted FROM queue q JOIN step s USING (n)""",
)
def _daily_limit(t):
    return limits.daily_limit(t.feedback, 1)


_LOG = """SELECT fingerprint, count, message, path, stack, resolved, created_at, last_seen_at
    FROM (SELECT substr(sha256(concat(exc_type, ':', file, ':', function)), 1, 32) AS fingerprint,
      count(*) AS count, arg_max(concat(exc_type, ': ', message), (ts, id)) AS message,
      arg_min(path, (ts, id)) AS path, arg_min(stack, (ts, id)) AS stack, false AS resolved,
      min(ts) AS created_at, max(ts) AS last_seen_at FROM error_events GROUP BY 1)"""
_LOG_COLUMNS = (
    "fingerprint:s count:i message:s path:s stack:s resolved:b created_at:t last_seen_at:t"
)
query("W4_error_log", _LOG_COLUMNS, "error_events", _LOG)(
    lambda t: errors.collapse_errors(t.error_events)
)
query("W4_error_stream", _LOG_COLUMNS, "error_events", _LOG)(
    lambda t: error_stream(_stream(t, "error_events"))
)


@query("W4_merge_errors", _LOG_COLUMNS, "error_events", _LOG)
def _merge_errors(t):
    early = F.col("ts") < F.lit("2024-01-12").cast("timestamp")
    log = errors.collapse_errors(t.error_events.filter(early)).withColumn("resolved", F.lit(True))
    late = errors.collapse_errors(t.error_events.filter(~early))
    known = late.select("fingerprint")
    untouched = log.join(known, "fingerprint", "left_anti").withColumn("resolved", F.lit(False))
    touched = log.join(known, "fingerprint", "left_semi")
    return errors.merge_errors(touched.unionByName(untouched), late)


_ACTIVITY = """SELECT window_end, count(*) AS recent_jobs,
    count(*) FILTER (status IN ('processing', 'queued')) AS active_jobs FROM (
      SELECT status, date_trunc('minute', created_at) + INTERVAL 1 MINUTE * k AS window_end
      FROM (SELECT *, unnest(range(1, 16)) AS k FROM event_jobs)) GROUP BY 1"""
_ACTIVITY_COLUMNS = "window_end:t recent_jobs:i active_jobs:i"
query("W5_activity_windows", _ACTIVITY_COLUMNS, "event_jobs", _ACTIVITY)(
    lambda t: activity.activity_windows(t.event_jobs)
)
query("W5_activity_stream", _ACTIVITY_COLUMNS, "event_jobs", _ACTIVITY)(
    lambda t: activity.activity_stream(_stream(t, "event_jobs"))
)

_STATES = """WITH retried AS (SELECT job_id, max((ts, seq)) FILTER (kind = 'retry') AS again
      FROM job_events GROUP BY 1),
    current AS (SELECT e.* FROM job_events e JOIN retried r USING (job_id)
      WHERE again IS NULL OR (e.ts, e.seq) >= again),
    ends AS (SELECT job_id, min((ts, seq)) FILTER (kind IN ('completed', 'failed', 'cancelled'))
      AS done FROM current GROUP BY 1),
    marked AS (SELECT c.*, done, (done IS NULL OR (c.ts, c.seq) <= done) AND kind <> 'expire'
      AS taken FROM current c JOIN ends USING (job_id)),
    folded AS (SELECT job_id, arg_max(CASE kind WHEN 'retry' THEN 'queued' ELSE kind END, (ts, seq))
        FILTER (taken AND kind <> 'progress') AS stage,
      arg_max(CASE kind WHEN 'completed' THEN 100 WHEN 'progress'
        THEN greatest(0, least(100, progress)) ELSE 0 END, (ts, seq)) FILTER (taken AND kind IN
        ('progress', 'processing', 'retry', 'completed')) AS progress,
      arg_max(coalesce(error_code, '-'), (ts, seq)) FILTER (taken AND kind <> 'progress') AS code,
      bool_or(coalesce((ts, seq) > done AND kind = 'expire', false)) AS expired
      FROM marked GROUP BY 1)
    SELECT job_id, CASE WHEN expired THEN 'expired' ELSE coalesce(stage, 'pending') END AS status,
      coalesce(progress, 0) AS progress, CASE WHEN stage = 'failed' THEN code END AS error_code
    FROM folded"""
_STATE_COLUMNS = "job_id:i status:s progress:i error_code:s"
query("W6_job_states", _STATE_COLUMNS, "job_events", _STATES)(
    lambda t: lifecycle.job_states(t.job_events)
)
query("U5_ordered_fold", _STATE_COLUMNS, "job_events", _STATES)(
    lambda t: lifecycle.folded_states(t.job_events)
)
query("W6_job_state_stream", _STATE_COLUMNS, "job_events", _STATES)(
    lambda t: lifecycle_stream(_stream(t, "job_events"))
)


@query(
    "W6_event_feed",
    "job_id:i seq:i kind:s rank:i",
    "job_events",
    """SELECT job_id, seq, kind, rank FROM (SELECT *, min(CASE WHEN kind IN
      ('completed', 'failed', 'cancelled') THEN rank END) OVER (PARTITION BY job_id) AS last
      FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS rank
        FROM job_events) WHERE rank <= 600) WHERE last IS NULL OR rank <= last""",
)
def _feed(t):
    return lifecycle.event_feed(t.job_events)


@query(
    "W8_trend_stream",
    "bucket:t v:i",
    "plain_visits",
    """SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS bucket,
    count(DISTINCT visitor_id) AS v FROM plain_visits GROUP BY 1""",
)
def _trend_stream(t):
    return visits.trend_stream(_stream(t, "plain_visits"))


@query("W8_trend_stream_approx", "bucket:t v:i")
def _trend_stream_approx(t):
    return visits.trend_stream(_stream(t, "plain_visits"), approx=True)
