"""Sources (S), joins (J), windows (N), listings (O) and maintenance (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.filters import has_attachment
from ..operators import dashboard, enrich, errors, jobs, limits, listings, maintenance, tools, uploads
from ..sources import events as event_feed
from ..sources import files as stored
from ..sources import tables as source_tables
from ..sources import visits as visit_source
from ..session import scratch
from ..streaming.runner import start
from .registry import query
from .testdata import EVENTS_NOW, FILES_NOW, ORDERS_NOW, stream_view

# ---- S: sources and sinks --------------------------------------------------------------


@query(
    "S1_table_scan",
    "id:i tool:s status:s user_id:i is_returning:b created_at:t",
    "processing_jobs",
    "SELECT * FROM processing_jobs",
)
def _scan(t):
    return t.processing_jobs


_VALID = "length(path) BETWEEN 1 AND 512 AND length(visitor_id) BETWEEN 1 AND 64"


@query(
    "S2_visit_ingest",
    "id:s valid:b is_returning:b device:s source:s",
    "raw_visits",
    f"""SELECT id, true AS valid,
      row_number() OVER (PARTITION BY visitor_id ORDER BY created_at, id) > 1 AS is_returning,
      CASE WHEN user_agent LIKE '%iPhone%' OR user_agent LIKE '%Mobile%' THEN 'Mobile'
        WHEN user_agent LIKE '%iPad%' THEN 'Tablet' ELSE 'Desktop' END AS device,
      CASE WHEN source IS NOT NULL THEN source WHEN coalesce(referrer, '') = '' THEN 'Direct'
        WHEN referrer LIKE '%google%' THEN 'Organic Search'
        WHEN referrer LIKE '%t.co%' THEN 'Social Media'
        WHEN referrer LIKE '%reddit.co%' THEN 'Social Media'
        WHEN referrer LIKE '%ads%' THEN 'Paid Ads' ELSE 'Referral' END AS source
    FROM raw_visits WHERE {_VALID}
    UNION ALL SELECT id, false, NULL, NULL, NULL FROM raw_visits WHERE NOT ({_VALID})""",
)
def _ingest(t):
    valid, rejected = visit_source.split_visits(t.raw_visits)
    accepted = enrich.enrich_visits(valid).withColumn("valid", F.lit(True))
    refused = rejected.select("id", F.lit(False).alias("valid"))
    return accepted.select("id", "valid", "is_returning", "device", "source").unionByName(
        refused, allowMissingColumns=True
    )


@query(
    "S3_manifest",
    "doc_id:i checksum_sha256:s size_bytes:i",
    "",
    """SELECT doc_id, sha256(text) AS checksum_sha256, octet_length(encode(text)) AS size_bytes
    FROM documents""",
)
def _manifest(t):
    contents = t.raw("documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return stored.manifest(contents)


# Files of more bytes than this are listed only.
LARGEST_PAGE = 4000


@query(
    "S3_file_manifest",
    "page_id:i size_bytes:i checksum_sha256:s error:s",
    "",
    f"""SELECT page_id, strlen(html) AS size_bytes,
    CASE WHEN strlen(html) <= {LARGEST_PAGE} THEN sha256(html) END AS checksum_sha256,
    CASE WHEN strlen(html) > {LARGEST_PAGE} THEN 'file_too_large' END AS error
    FROM (SELECT page_id, CASE WHEN page_id % 50 = 0 THEN '' ELSE coalesce(html, '') END AS html FROM pages)""",
)
def _file_manifest(t):
    """Every page as a file, every fiftieth an empty one, and the manifest of their folder."""
    folder = scratch(t.spark, "files")
    shard = F.pmod(F.col("page_id"), F.lit(16)).cast("string")
    name = F.concat(shard, F.lit("/"), F.col("page_id").cast("string"), F.lit(".html"))
    html = F.when(F.col("page_id") % 50 != 0, F.col("html"))
    stored.write_contents(t.raw("pages").select(name.alias("relative_path"), html.alias("content")), folder)
    page = F.regexp_extract("path", r"([0-9]+)\.html$", 1).cast("long")
    return stored.file_manifest(t.spark, folder, LARGEST_PAGE).withColumn("page_id", page)


@query(
    "S4_sharded_layout",
    "id:s stored_name:s relative_path:s",
    "plain_visits",
    """SELECT id, concat(substr(sha256(id), 1, 32), '.pdf') AS stored_name,
    concat(strftime(created_at, '%Y/%m/%d/'), substr(sha256(id), 1, 32), '.pdf') AS relative_path
    FROM plain_visits""",
)
def _layout(t):
    return stored.allocate(t.plain_visits, F.col("id"), F.lit(".PDF"), F.col("created_at"))


_PRODUCED = """SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY file_id, position)
    - 1 AS position, file_id FROM job_files WHERE role = 'output'"""


def _produced(t):
    outputs = t.job_files.filter("role = 'output'").select(
        "job_id",
        F.col("position").cast("long").alias("position"),
        F.concat(F.lit("out "), F.col("file_id").cast("string"), F.lit(".PDF")).alias(
            "download_name"
        ),
        F.lit("application/pdf").alias("media_type"),
        (F.col("file_id") * 10).alias("size_bytes"),
        F.sha2(F.col("file_id").cast("string"), 256).alias("checksum_sha256"),
    )
    return stored.stage_outputs(outputs, t.processing_jobs, ORDERS_NOW)


@query(
    "S5_output_files",
    "id:s original_name:s relative_path:s user_id:i expires_at:t size_bytes:i",
    "job_files processing_jobs",
    """SELECT id, original_name, concat('2001/08/02/', substr(sha256(id), 1, 32), '.pdf')
      AS relative_path, user_id, TIMESTAMP '2001-08-03' AS expires_at, size_bytes FROM (
    SELECT substr(sha256(concat(l.job_id, '|output|', l.position)), 1, 32) AS id,
      concat('out ', l.file_id, '.PDF') AS original_name, j.user_id, l.file_id * 10 AS size_bytes
    FROM job_files l JOIN processing_jobs j ON l.job_id = j.id WHERE l.role = 'output')""",
)
def _output_files(t):
    return stored.output_files(_produced(t))


@query(
    "S5_output_links",
    "job_id:i file_id:s role:s position:i",
    "job_files processing_jobs",
    """SELECT l.job_id, substr(sha256(concat(l.job_id, '|output|', l.position)), 1, 32) AS file_id,
    'output' AS role, l.position FROM job_files l JOIN processing_jobs j ON l.job_id = j.id
    WHERE l.role = 'output'""",
)
def _output_links(t):
    return stored.output_links(_produced(t))


@query(
    "S6_job_events",
    "channel:s value:s",
    "processing_jobs",
    """SELECT concat('job-events:', id) AS channel, concat('{"id":"', id, '","status":"', status,
    '","progress":', progress, ',"error_code":',
    CASE status WHEN 'failed' THEN '"PROCESSING_FAILED"' ELSE 'null' END, '}') AS value
    FROM processing_jobs""",
)
def _job_events(t):
    code = F.when(F.col("status") == "failed", "PROCESSING_FAILED")
    return event_feed.encode_events(t.processing_jobs.withColumn("error_code", code))


@query(
    "S6_job_events_decoded",
    "channel:s id:s status:s progress:i error_code:s",
    "processing_jobs",
    """SELECT concat('job-events:', id) AS channel, CAST(id AS VARCHAR) AS id, status, progress,
    NULL AS error_code FROM processing_jobs""",
)
def _job_events_decoded(t):
    jobs_in = t.processing_jobs.withColumn("error_code", F.lit(None).cast("string"))
    return event_feed.decode_events(event_feed.encode_events(jobs_in))


_FEED = """SELECT concat('job-events:', job_id) AS channel, CAST(job_id AS VARCHAR) AS id,
    kind AS status, progress, error_code FROM job_events"""
_FEED_COLUMNS = "channel:s id:s status:s progress:i error_code:s"


def _feed_jobs(t):
    return t.job_events.withColumnsRenamed({"job_id": "id", "kind": "status"})


@query("S6_event_folder", _FEED_COLUMNS, "job_events", _FEED)
def _event_folder(t):
    """Job events appended to a folder in two batches and read back."""
    folder = scratch(t.spark, "events")
    jobs_in = _feed_jobs(t)
    event_feed.publish_events(jobs_in.filter("seq % 2 = 0"), folder)
    event_feed.publish_events(jobs_in.filter("seq % 2 <> 0"), folder)
    return event_feed.read_events(t.spark, folder)


@query("S6_event_stream", _FEED_COLUMNS, "job_events", _FEED)
def _event_stream(t):
    """Job events streamed into a folder, and streamed from there into a table."""
    folder = scratch(t.spark, "events")
    jobs_in = stream_view(t.spark, t.folder, "job_events")
    jobs_in = jobs_in.withColumnsRenamed({"job_id": "id", "kind": "status"})
    event_feed.publish_event_stream(jobs_in, folder, f"{folder}-sent").awaitTermination()
    events = event_feed.read_event_stream(t.spark, folder)
    writer = events.writeStream.format("parquet").option("path", f"{folder}-table")
    start(writer, f"{folder}-received").awaitTermination()
    return t.spark.read.schema(events.schema).parquet(f"{folder}-table")


@query(
    "S7_seed_users",
    "id:i email:s",
    "users subscriptions",
    "SELECT id, email FROM users WHERE id NOT IN (SELECT user_id FROM subscriptions)",
)
def _seed(t):
    return source_tables.missing_rows(
        t.users, t.subscriptions.select(F.col("user_id").alias("id")).distinct(), "id"
    )


query(
    "J12_anti_join",
    "id:i tool:s",
    "processing_jobs job_files",
    """SELECT id, tool FROM processing_jobs j
    WHERE NOT EXISTS (SELECT 1 FROM job_files l WHERE l.job_id = j.id)""",
)(
    lambda t: source_tables.missing_rows(
        t.processing_jobs, t.job_files.select(F.col("job_id").alias("id")), "id"
    )
)


@query(
    "S10_get_many",
    "request_id:i pos:i id:i original_name:s",
    "stored_files",
    """SELECT r.request_id, r.pos, f.id, f.original_name FROM (
      SELECT o_orderkey AS request_id, unnest([0, 1, 2]) AS pos,
        unnest([o_custkey, -1, o_custkey]) AS id FROM orders) r
    JOIN stored_files f ON f.id = r.id""",
)
def _get_many(t):
    requests = t.raw("orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.array(F.col("o_custkey"), F.lit(-1).cast("long"), F.col("o_custkey")).alias("ids"),
    )
    return jobs.get_many(requests, t.stored_files)


@query(
    "S11_audit_rows",
    "id:s action:s category:s summary:s entity_id:s meta:s created_at:t",
    "users",
    """SELECT substr(sha256(concat('users.suspend|2024-01-31 00:00:00|user|', id, '|', summary)),
      1, 32) AS id, 'users.suspend' AS action, 'audit' AS category, summary,
      CAST(id AS VARCHAR) AS entity_id, '{}' AS meta, TIMESTAMP '2024-01-31' AS created_at
    FROM (SELECT id, concat('Suspended ', email) AS summary FROM users WHERE status <> 'suspended')
    """,
)
def _audit(t):
    changed = maintenance.bulk_users(t.users, t.users, "suspend").filter("changed")
    return source_tables.audit_rows(
        changed,
        "users.suspend",
        F.concat(F.lit("Suspended "), "email"),
        FILES_NOW,
        entity_type=F.lit("user"),
        entity_id=F.col("id"),
    )


# ---- J: joins ----------------------------------------------------------------------------


@query(
    "J1_subscribers",
    "id:i user_id:i user_email:s price_cents:i",
    "subscriptions users",
    """SELECT s.id, s.user_id, u.email AS user_email, s.price_cents
    FROM subscriptions s JOIN users u ON s.user_id = u.id""",
)
def _subscribers(t):
    return jobs.with_subscriber(t.subscriptions, t.users)


@query(
    "J2_file_owners",
    "id:i original_name:s owner_email:s",
    "stored_files users",
    """SELECT f.id, f.original_name, u.email AS owner_email
    FROM stored_files f LEFT JOIN users u ON f.user_id = u.id""",
)
def _file_owners(t):
    return jobs.with_user_email(t.stored_files, t.users, "owner_email")


@query(
    "J3_job_users",
    "id:i tool:s user_email:s",
    "processing_jobs users",
    """SELECT j.id, j.tool, u.email AS user_email
    FROM processing_jobs j LEFT JOIN users u ON j.user_id = u.id""",
)
def _job_users(t):
    return jobs.with_user_email(t.processing_jobs, t.users)


@query(
    "J4_input_links",
    "tool:s n:i",
    "job_files processing_jobs",
    """SELECT j.tool, count(*) AS n FROM job_files l JOIN processing_jobs j ON l.job_id = j.id
    WHERE l.role = 'input' GROUP BY j.tool""",
)
def _input_links(t):
    links = tools.input_links(t.job_files, t.processing_jobs)
    return links.groupBy("tool").agg(F.count("*").alias("n"))


@query(
    "J5_input_files",
    "tool:s file_id:i n:i bytes:i",
    "job_files processing_jobs stored_files",
    """SELECT j.tool, f.id AS file_id, count(*) AS n, sum(f.size_bytes) AS bytes
    FROM job_files l JOIN processing_jobs j ON l.job_id = j.id
    JOIN stored_files f ON l.file_id = f.id WHERE l.role = 'input' GROUP BY j.tool, f.id""",
)
def _input_files(t):
    found = tools.input_files(t.job_files, t.processing_jobs, t.stored_files)
    return found.groupBy("tool", "file_id").agg(
        F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")
    )


@query(
    "J6_jobs_per_user",
    "id:i conversions:i",
    "users processing_jobs",
    """SELECT id, (SELECT count(*) FROM processing_jobs j WHERE j.user_id = u.id) AS conversions
    FROM users u""",
)
def _jobs_per_user(t):
    counts = dashboard.rows_per_user(t.processing_jobs, "conversions")
    return t.users.join(counts, "id", "left").na.fill(0, ["conversions"])


@query(
    "J7_latest_tool",
    "file_id:i tool:s",
    "job_files processing_jobs",
    """SELECT file_id, tool FROM (SELECT l.file_id, j.tool, row_number() OVER (
      PARTITION BY l.file_id ORDER BY j.created_at DESC, j.id DESC) AS r
      FROM job_files l JOIN processing_jobs j ON l.job_id = j.id) WHERE r = 1""",
)
def _latest_tool(t):
    return jobs.latest_tool_of_file(t.job_files, t.processing_jobs)


_LATEST_SUBSCRIPTION = """SELECT id, user_id, status, price_cents FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r
    FROM subscriptions) WHERE r = 1"""
query(
    "J8_latest_subscription", "id:i user_id:i status:s price_cents:i", "subscriptions",
    _LATEST_SUBSCRIPTION,
)(lambda t: jobs.latest_subscription(t.subscriptions))
query(
    "N4_latest_per_key", "id:i user_id:i status:s price_cents:i", "subscriptions",
    _LATEST_SUBSCRIPTION,
)(
    lambda t: maintenance.latest_per_key(t.subscriptions, ["user_id"], ["created_at", "id"])
)


@query(
    "J9_seen_before",
    "id:i is_returning:b",
    "plain_visits event_jobs",
    """SELECT id, EXISTS (SELECT 1 FROM plain_visits v WHERE v.visitor_id = j.visitor_id
    AND v.created_at < j.created_at) AS is_returning FROM event_jobs j""",
)
def _seen(t):
    return enrich.seen_before(t.event_jobs, t.plain_visits)


@query(
    "J10_session_source",
    "id:i source:s",
    "plain_visits event_jobs",
    """SELECT j.id, coalesce(s.source, 'Direct') AS source FROM event_jobs j LEFT JOIN (
      SELECT session_id, arg_min(source, (created_at, id)) AS source FROM plain_visits
      GROUP BY session_id) s ON s.session_id = j.session_id""",
)
def _session_source(t):
    return enrich.attribute_sources(t.event_jobs, t.plain_visits)


@query(
    "J13_nested_files",
    "job_id:i role:s part:i files:s",
    "job_files stored_files",
    """SELECT job_id, role, (n - 1) // 1000 AS part, string_agg(concat(position, ':', file_id, ':',
    original_name), ',' ORDER BY position, file_id) AS files FROM (
      SELECT l.*, f.original_name, row_number() OVER (
        PARTITION BY job_id, role ORDER BY position, file_id) AS n
      FROM job_files l LEFT JOIN stored_files f ON l.file_id = f.id)
    GROUP BY job_id, role, part""",
)
def _nested(t):
    nested = jobs.nested_files(t.job_files, t.stored_files)
    item = F.transform(
        "files",
        lambda f: F.concat_ws(
            ":", f["position"].cast("string"), f["file_id"].cast("string"), f["original_name"]
        ),
    )
    return nested.withColumn("files", F.array_join(item, ","))


@query(
    "J14_display_names",
    "job_id:i file_name:s",
    "job_files stored_files",
    """SELECT job_id, original_name AS file_name FROM (SELECT l.job_id, f.original_name,
      row_number() OVER (PARTITION BY l.job_id ORDER BY l.role <> 'input', l.position, l.file_id)
      AS r FROM job_files l LEFT JOIN stored_files f ON l.file_id = f.id) WHERE r = 1""",
)
def _names(t):
    return jobs.display_names(t.job_files, t.stored_files)


# ---- N: windows ------------------------------------------------------------------------------


@query("N1_returning_visits", "id:s is_returning:b", "page_visits", "SELECT * FROM page_visits")
def _returning(t):
    return t.page_visits


@query(
    "N2_upload_batches",
    "batch_id:i n_files:i accepted:b reason:s failed_position:i",
    "",
    """WITH items AS (SELECT o_custkey // 3 AS batch_id, o_orderkey AS position,
        CAST(o_totalprice AS BIGINT) * 60 AS size FROM orders),
      sized AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS n, coalesce(sum(size) OVER (
        PARTITION BY batch_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        0) AS taken FROM items),
      judged AS (SELECT *, CASE WHEN n > 50 THEN NULL
        WHEN size > least(524288000, 524288000 - taken) THEN CASE
          WHEN 524288000 - taken < 524288000 THEN 'combined_limit' ELSE 'file_limit' END END
        AS problem FROM sized)
    SELECT batch_id, n AS n_files, n <= 50 AND count(problem) = 0 AS accepted,
      CASE WHEN n > 50 THEN 'too_many_files' ELSE arg_min(problem, position)
        FILTER (problem IS NOT NULL) END AS reason,
      min(position) FILTER (problem IS NOT NULL) AS failed_position
    FROM judged GROUP BY batch_id, n""",
)
def _uploads(t):
    items = t.raw("orders").select(
        F.floor(F.col("o_custkey") / 3).alias("batch_id"),
        F.col("o_orderkey").alias("position"),
        F.lit("a.pdf").alias("filename"),
        F.lit(b"%PDF-1.7").alias("head"),
        (F.round("o_totalprice").cast("long") * 60).alias("size_bytes"),
        F.lit("Basic").alias("plan"),
    )
    return uploads.validate_uploads(items)


@query(
    "N3_rate_limit",
    "id:i bucket:s client_ip:s rejected:b",
    "requests",
    """SELECT id, bucket, client_ip, row_number() OVER (
      PARTITION BY bucket, client_ip, floor(epoch(ts) / 60) ORDER BY ts, id) > 5 AS rejected
    FROM requests""",
)
def _rate_limit(t):
    return limits.rate_limit(t.requests, 5)


# ---- O: sorting, paging, listings --------------------------------------------------------------


def _page_sql(columns: str, source: str, where: str, order: str, size: int, offset: int = 0) -> str:
    return f"SELECT {columns} FROM {source} WHERE {where} ORDER BY {order} LIMIT {size} OFFSET {offset}"


@query(
    "O1_whitelisted_sort",
    "id:i user_name:s renews_at:t",
    "subscriptions users",
    _page_sql(
        "*", """(SELECT s.*, u.name AS user_name FROM subscriptions s JOIN users u
        ON u.id = s.user_id)""", "true", "renews_at DESC NULLS FIRST, id", 90,
    ),
)
def _sorted(t):
    spec = listings.LISTINGS["subscriptions"]
    rows = jobs.with_subscriber(t.subscriptions, t.users)
    return rows.orderBy(*listings.sort_columns(spec, "-renews_at")).limit(90)


@query(
    "O2_offset_page",
    "id:i tool:s status:s",
    "processing_jobs",
    _page_sql(
        "*", "processing_jobs", "true",
        "CASE status WHEN 'queued' THEN 1 WHEN 'completed' THEN 3 ELSE 4 END, id", 40, 80,
    ),
)
def _page(t):
    spec = listings.LISTINGS["jobs"]
    return listings.page_of(t.processing_jobs, listings.sort_columns(spec, "status"), 3, 40)


@query(
    "O3_newest_of_owner",
    "id:i tool:s created_at:t",
    "processing_jobs",
    _page_sql("*", "processing_jobs", "user_id = 7", "created_at DESC, id", 50),
)
def _mine(t):
    return listings.newest_of_owner(t.processing_jobs, 7)


@query(
    "O3_active_files_of_owner",
    "id:i original_name:s created_at:t",
    "stored_files",
    _page_sql(
        "*", "(SELECT * REPLACE (user_id % 5 AS user_id) FROM stored_files)",
        "user_id = 2 AND status = 'active'", "created_at DESC, id", 60, 20,
    ),
)
def _my_files(t):
    files = t.stored_files.withColumn("user_id", F.col("user_id") % 5)
    return listings.newest_of_owner(files, 2, limit=60, offset=20, status="active")


@query(
    "O4_fixed_order",
    "fingerprint:s resolved:b last_seen_at:t",
    "error_events",
    """SELECT fingerprint, resolved, last_seen_at FROM (SELECT
      substr(sha256(concat(exc_type, ':', file, ':', function)), 1, 32) AS fingerprint,
      count(*) % 2 = 0 AS resolved, min(ts) AS created_at, max(ts) AS last_seen_at
      FROM error_events GROUP BY 1) ORDER BY resolved, created_at DESC, fingerprint LIMIT 25""",
)
def _error_order(t):
    log = errors.collapse_errors(t.error_events).withColumn("resolved", F.col("count") % 2 == 0)
    return listings.page_of(log, listings.sort_columns(listings.LISTINGS["errors"], None), 1, 25)


def _audit_log(t):
    return t.event_jobs.select(
        "id",
        F.col("tool").alias("action"),
        F.concat(F.lit("Job "), F.col("id").cast("string")).alias("summary"),
        F.lit("admin@example.com").alias("actor_email"),
        F.when(F.col("status") == "failed", "security").otherwise("audit").alias("category"),
        "created_at",
    )


_AUDIT = """SELECT id, tool AS action, concat('Job ', id) AS summary,
    CASE status WHEN 'failed' THEN 'security' ELSE 'audit' END AS category, created_at
    FROM event_jobs"""


@query(
    "O5_recent_activity",
    "id:i action:s summary:s category:s created_at:t",
    "event_jobs",
    _page_sql("*", f"({_AUDIT})", "true", "created_at DESC, id", 6),
)
def _recent(t):
    return listings.recent_activity(_audit_log(t), 6)


@query(
    "O6_live_feed",
    "id:i tool:s status:s user_email:s created_at:t",
    "event_jobs users",
    """SELECT j.*, u.email AS user_email FROM event_jobs j LEFT JOIN users u ON j.user_id = u.id
    WHERE j.created_at >= TIMESTAMP '2024-01-15 05:45:00' ORDER BY j.created_at DESC, j.id
    LIMIT 15""",
)
def _feed(t):
    return listings.live_feed(t.event_jobs, t.users, "2024-01-15 06:00:00")


@query(
    "O7_list_users",
    "id:i email:s conversions:i",
    "users processing_jobs",
    _page_sql(
        "*", """(SELECT *, (SELECT count(*) FROM processing_jobs j WHERE j.user_id = u.id)
        AS conversions FROM users u)""", "plan = 'pro' AND lower(name) LIKE '%customer%1%'",
        "created_at DESC, id", 20, 20,
    ),
)
def _list_users(t):
    return listings.list_users(
        t.users, t.processing_jobs, q="Customer%1", sort="unknown", page=2, plan="pro"
    )


@query(
    "O7_list_users_by_conversions",
    "id:i email:s conversions:i",
    "users processing_jobs",
    _page_sql(
        "*", """(SELECT *, (SELECT count(*) FROM processing_jobs j WHERE j.user_id = u.id)
        AS conversions FROM users u)""", "true", "conversions DESC, id", 20,
    ),
)
def _list_users_by_conversions(t):
    return listings.list_users(t.users, t.processing_jobs, sort="-conversions")


@query(
    "O7_list_subscriptions",
    "id:i user_name:s price_cents:i",
    "subscriptions users",
    _page_sql(
        "*", """(SELECT s.*, u.name AS user_name FROM subscriptions s JOIN users u
        ON u.id = s.user_id)""", "status = 'active'", "price_cents DESC, id", 20,
    ),
)
def _list_subscriptions(t):
    return listings.list_subscriptions(t.subscriptions, t.users, sort="-price", status="active")


@query(
    "O7_list_files",
    "id:i original_name:s owner_email:s tool:s size_bytes:i",
    "stored_files users job_files processing_jobs",
    """SELECT f.*, u.email AS owner_email, (SELECT j.tool FROM job_files l JOIN processing_jobs j
      ON l.job_id = j.id WHERE l.file_id = f.id ORDER BY j.created_at DESC, j.id DESC LIMIT 1)
      AS tool FROM stored_files f LEFT JOIN users u ON f.user_id = u.id
    WHERE f.category = 'upload' ORDER BY f.size_bytes, f.id LIMIT 20""",
)
def _list_files(t):
    return listings.list_files(
        t.stored_files, t.users, t.job_files, t.processing_jobs, sort="size", category="upload"
    )


@query(
    "O7_list_jobs",
    "id:i tool:s user_email:s file_name:s",
    "processing_jobs users job_files stored_files",
    """SELECT j.*, u.email AS user_email, (SELECT f.original_name FROM job_files l
      LEFT JOIN stored_files f ON l.file_id = f.id WHERE l.job_id = j.id
      ORDER BY l.role <> 'input', l.position, l.file_id LIMIT 1) AS file_name
    FROM processing_jobs j LEFT JOIN users u ON j.user_id = u.id
    WHERE j.status = 'failed' AND lower(j.tool) LIKE '%hi_h%'
    ORDER BY j.created_at DESC, j.id LIMIT 20""",
)
def _list_jobs(t):
    return listings.list_jobs(
        t.processing_jobs, t.users, t.job_files, t.stored_files, q="HI_H", status="failed"
    )


@query(
    "O7_list_feedback",
    "id:i email:s has_attachment:b",
    "feedback",
    _page_sql(
        "*, attachment_data IS NOT NULL AS has_attachment", "feedback",
        "category = 'bug' AND lower(email) LIKE '%user%'", "created_at DESC, id", 20,
    ),
)
def _list_feedback(t):
    return listings.list_feedback(t.feedback, q="USER", category="bug")


@query(
    "O7_list_messages",
    "id:i email:s subject:s",
    "feedback",
    _page_sql(
        "*", "feedback", "NOT is_read AND lower(subject) LIKE '%subject 2%'",
        "created_at DESC, id", 20,
    ),
)
def _list_messages(t):
    return listings.listing(t.feedback, "messages", q="subject 2", unread=True)[0]


@query(
    "O7_list_audit",
    "id:i action:s summary:s",
    "event_jobs",
    _page_sql(
        "*", f"({_AUDIT})", "category = 'security' AND lower(summary) LIKE '%job 1%'",
        "created_at DESC, id", 20,
    ),
)
def _list_audit(t):
    return listings.listing(_audit_log(t), "audit", q="Job 1", category="security")[0]


@query(
    "O7_list_errors",
    "fingerprint:s message:s count:i",
    "error_events",
    """SELECT fingerprint, message, count FROM (SELECT
      substr(sha256(concat(exc_type, ':', file, ':', function)), 1, 32) AS fingerprint,
      count(*) AS count, min(ts) AS created_at,
      arg_max(concat(exc_type, ': ', message), (ts, id)) AS message
      FROM error_events GROUP BY 1) WHERE lower(message) LIKE '%error1%'
    ORDER BY created_at DESC, fingerprint LIMIT 20""",
)
def _list_errors(t):
    log = errors.collapse_errors(t.error_events)
    return listings.listing(log, "errors", q="ERROR1", level="error")[0]


@query(
    "O7_listing_total",
    "total:i pages:i",
    "feedback",
    """SELECT count(*) AS total, ceil(count(*) / 20.0) AS pages FROM feedback
    WHERE category = 'bug'""",
)
def _total(t):
    rows = t.feedback.withColumn("has_attachment", has_attachment())
    return listings.listing(rows, "feedback", category="bug")[1]


# ---- M: maintenance --------------------------------------------------------------------------------

_DUE = "status = 'active' AND expires_at < TIMESTAMP '2024-01-31'"


@query(
    "M1_expire_files",
    "id:i status:s",
    "stored_files",
    f"SELECT id, CASE WHEN {_DUE} THEN 'expired' ELSE status END AS status FROM stored_files",
)
def _expire(t):
    return maintenance.expire_files(t.stored_files, FILES_NOW)


@query(
    "M1_expire_jobs",
    "id:i status:s",
    "event_jobs",
    """SELECT id, CASE WHEN status IN ('completed', 'failed', 'cancelled')
    AND expires_at < TIMESTAMP '2024-01-15' THEN 'expired' ELSE status END AS status
    FROM event_jobs""",
)
def _expire_jobs(t):
    return maintenance.expire_jobs(t.event_jobs, "2024-01-15 00:00:00")


@query(
    "M2_stale_scratch",
    "id:s created_at:t",
    "plain_visits",
    "SELECT * FROM plain_visits WHERE created_at < TIMESTAMP '2024-01-30 22:00:00'",
)
def _stale(t):
    entries = t.plain_visits.withColumn("modificationTime", F.col("created_at"))
    return maintenance.stale_scratch(entries, EVENTS_NOW)


def _subscribed(t):
    return t.subscriptions.select(F.col("user_id").alias("id"))


@query(
    "M3_bulk_suspend",
    "id:i status:s changed:b",
    "users subscriptions",
    """SELECT id, CASE WHEN hit THEN 'suspended' ELSE status END AS status,
      hit AND status <> 'suspended' AS changed
    FROM (SELECT *, id IN (SELECT user_id FROM subscriptions) AS hit FROM users)""",
)
def _suspend(t):
    return maintenance.bulk_users(t.users, _subscribed(t), "suspend")


@query(
    "M3_bulk_delete",
    "id:i status:s",
    "users subscriptions",
    "SELECT id, status FROM users WHERE id NOT IN (SELECT user_id FROM subscriptions)",
)
def _delete_users(t):
    return maintenance.bulk_users(t.users, _subscribed(t), "delete")


@query(
    "M4_patch",
    "id:i plan:s status:s name:s",
    "users subscriptions",
    """SELECT u.id, coalesce(p.plan, u.plan) AS plan, coalesce(p.status, u.status) AS status,
      u.name FROM users u LEFT JOIN (
      SELECT user_id, arg_max(plan, id) AS plan, arg_max(status, id)
        FILTER (status <> 'cancelled') AS status FROM subscriptions GROUP BY user_id) p
    ON p.user_id = u.id""",
)
def _patch(t):
    patches = t.subscriptions.select(
        F.col("user_id").alias("id"),
        F.col("id").alias("at"),
        "plan",
        F.when(F.col("status") != "cancelled", F.col("status")).alias("status"),
    )
    return maintenance.patch(t.users, patches, "id", order="at")


@query(
    "M5_forget_owner",
    "id:i user_id:i",
    "processing_jobs users",
    """SELECT id, CASE WHEN user_id IN (SELECT id FROM users WHERE status = 'inactive') THEN NULL
    ELSE user_id END AS user_id FROM processing_jobs""",
)
def _forget(t):
    gone = t.users.filter("status = 'inactive'")
    return maintenance.forget_owner(t.processing_jobs, gone)


@query(
    "M5_cascade",
    "id:i user_id:i",
    "subscriptions users",
    """SELECT id, user_id FROM subscriptions
    WHERE user_id NOT IN (SELECT id FROM users WHERE status = 'inactive')""",
)
def _cascade(t):
    return maintenance.cascade(t.subscriptions, t.users.filter("status = 'inactive'"), "user_id")


@query(
    "M6_delete_files",
    "id:i status:s",
    "stored_files job_files",
    """SELECT id, CASE WHEN id IN (SELECT file_id FROM job_files WHERE position = 7
    AND role = 'output') THEN 'deleted' ELSE status END AS status FROM stored_files""",
)
def _delete_files(t):
    ids = t.job_files.filter("position = 7 AND role = 'output'")
    return maintenance.delete_files(t.stored_files, ids.select(F.col("file_id").alias("id")))


@query(
    "M7_cancel",
    "id:i status:s rejected:b finished_at:t",
    "event_jobs processing_jobs",
    """SELECT id, CASE WHEN hit AND NOT done THEN 'cancelled' ELSE status END AS status,
      hit AND done AS rejected,
      CASE WHEN hit AND NOT done THEN TIMESTAMP '2024-01-31' ELSE finished_at END AS finished_at
    FROM (SELECT *, status IN ('completed', 'failed', 'cancelled', 'expired') AS done,
      id IN (SELECT id FROM processing_jobs WHERE is_returning) AS hit FROM event_jobs)""",
)
def _cancel(t):
    ids = t.processing_jobs.filter("is_returning")
    return maintenance.cancel_jobs(t.event_jobs, ids, FILES_NOW)


@query(
    "M7_retry",
    "id:i status:s progress:i",
    "event_jobs processing_jobs",
    """SELECT id, CASE WHEN hit THEN 'queued' ELSE status END AS status,
      CASE WHEN hit THEN 0 ELSE progress END AS progress
    FROM (SELECT *, id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS hit
      FROM processing_jobs)""",
)
def _retry(t):
    ids = t.raw("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return maintenance.retry_jobs(t.processing_jobs, ids)


@query(
    "M8_register_users",
    "id:i email:s",
    "feedback users",
    """SELECT id, email FROM (SELECT id, lower(trim(email)) AS email, row_number() OVER (
      PARTITION BY lower(trim(email)) ORDER BY created_at, id) AS r FROM (
      SELECT id, created_at, CASE WHEN id % 5 = 0 THEN 'customer#000000001@example.com'
        ELSE email END AS email FROM feedback)) q
    WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM users u WHERE lower(u.email) = q.email)""",
)
def _register(t):
    email = F.when(F.col("id") % 5 == 0, "Customer#000000001@Example.com").otherwise(
        F.concat(F.lit(" "), F.upper("email"))
    )
    candidates = t.feedback.select("id", "name", email.alias("email"), "created_at")
    return maintenance.register_users(candidates, t.users)


@query(
    "M10_overlay_settings",
    "key:s k:s mode:s flag:b kept:s",
    "",
    """SELECT CAST(event_id AS VARCHAR) AS key, json_extract_string(props, '$.k') AS k,
    CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS mode,
    CASE WHEN event_id % 2 = 0 THEN false END AS flag, event_type AS kept FROM events""",
)
def _overlay(t):
    key = F.col("event_id").cast("string").alias("key")
    base = F.concat(
        F.lit('{"props":'), "props", F.lit(',"ui":{"mode":"old","kept":"'), "event_type",
        F.lit('"}}'),
    )
    events = t.raw("events")
    merged = maintenance.overlay_settings(
        events.select(key, base.alias("value")),
        events.filter("event_id % 2 = 0").select(
            key, F.lit('{"ui":{"mode":"new","flag":false}}').alias("value")
        ),
    )
    path = {"k": "$.props.k", "mode": "$.ui.mode", "flag": "$.ui.flag", "kept": "$.ui.kept"}
    return merged.select(
        "key", *[F.get_json_object("value", p).alias(name) for name, p in path.items()]
    )


@query(
    "M11_resolve_errors",
    "fingerprint:s resolved:b",
    "error_events",
    """SELECT fingerprint, max(hit) AS resolved FROM (SELECT
      substr(sha256(concat(exc_type, ':', file, ':', function)), 1, 32) AS fingerprint,
      exc_type = 'Error3' AS hit FROM error_events) GROUP BY 1""",
)
def _resolve(t):
    log = errors.collapse_errors(t.error_events)
    known = errors.collapse_errors(t.error_events.filter("exc_type = 'Error3'"))
    return errors.set_resolved(log, known.select("fingerprint"))


@query(
    "M11_clear_resolved",
    "fingerprint:s count:i",
    "error_events",
    """SELECT substr(sha256(concat(exc_type, ':', file, ':', function)), 1, 32) AS fingerprint,
    count(*) AS count FROM error_events WHERE exc_type <> 'Error3' GROUP BY 1""",
)
def _clear(t):
    log = errors.collapse_errors(t.error_events)
    known = errors.collapse_errors(t.error_events.filter("exc_type = 'Error3'"))
    return errors.clear_resolved(errors.set_resolved(log, known.select("fingerprint")))


@query(
    "M11_reply_messages",
    "id:i reply:s is_read:b replied_at:t",
    "feedback",
    """SELECT id, CASE WHEN id % 3 = 0 THEN 'Thanks' END AS reply, is_read OR id % 3 = 0 AS is_read,
    CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-01-31' END AS replied_at FROM feedback""",
)
def _reply(t):
    messages = t.feedback.withColumns(
        {"reply": F.lit(None).cast("string"), "replied_at": F.lit(None).cast("timestamp")}
    )
    replies = t.feedback.filter("id % 3 = 0").select("id", F.lit("Thanks").alias("reply"))
    return maintenance.reply_messages(messages, replies, FILES_NOW)


@query(
    "M11_mark_read",
    "id:i is_read:b",
    "feedback",
    "SELECT id, is_read OR category = 'bug' AS is_read FROM feedback",
)
def _mark_read(t):
    return maintenance.mark_read(t.feedback, t.feedback.filter("category = 'bug'"))
