"""Adapter views that give the test tables the product's schemas.

The statements run unchanged in Spark and in DuckDB.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators.enrich import mark_returning
from ..session import configure

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

EVENTS_NOW = "2024-01-31 00:00:00"
ORDERS_NOW = "2001-08-02 00:00:00"
FILES_NOW = "2024-01-31 00:00:00"

_VISIT_COLUMNS = """CAST(event_id AS STRING) AS id, CAST(user_id AS STRING) AS visitor_id,
  concat(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS session_id,
  concat('/', event_type) AS path,
  CASE user_id % 3 WHEN 0 THEN 'Desktop' WHEN 1 THEN 'Mobile' ELSE 'Tablet' END AS device,
  CASE user_id % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' WHEN 2 THEN 'Firefox' ELSE NULL END
    AS browser,
  CASE user_id % 4 WHEN 0 THEN 'Windows' WHEN 1 THEN 'macOS' ELSE 'Linux' END AS os,
  CASE user_id % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'IN' WHEN 2 THEN 'DE' WHEN 3 THEN 'FR' ELSE 'GB'
    END AS country,
  CASE user_id % 2 WHEN 0 THEN 'Direct' ELSE 'Organic Search' END AS source"""

VIEWS = {
    # Visits before the returning flag; Spark adds the flag with its own operator.
    "plain_visits": f"SELECT {_VISIT_COLUMNS}, ts AS created_at FROM events",
    "raw_visits": """SELECT CAST(event_id AS STRING) AS id,
  CAST(user_id AS STRING) AS visitor_id,
  concat(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS session_id,
  CASE WHEN event_id % 97 = 0 THEN '' ELSE concat('/', event_type) END AS path,
  CASE event_id % 7 WHEN 0 THEN 'https://www.google.com/search' WHEN 1 THEN 'https://t.co/x'
    WHEN 2 THEN 'https://github.com/a' WHEN 3 THEN 'https://www.reddit.com/r'
    WHEN 4 THEN 'https://ads.example.net' WHEN 5 THEN '' ELSE NULL END AS referrer,
  CASE WHEN event_id % 11 = 0 THEN 'Newsletter' ELSE NULL END AS source,
  CASE event_id % 8
    WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0) AppleWebKit Chrome/120.0 Safari/537.36'
    WHEN 1 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Version/17.0 Mobile Safari'
    WHEN 2 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) Version/17.0 Safari/605'
    WHEN 3 THEN 'Mozilla/5.0 (Linux; Android 14) Chrome/120.0 Mobile Safari/537.36'
    WHEN 4 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:120.0) Gecko Firefox/120.0'
    WHEN 5 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edg/120.0'
    WHEN 6 THEN 'Mozilla/5.0 (iPad; CPU OS 17_0 like Mac OS X) Version/17.0 Safari'
    ELSE '' END AS user_agent,
  CASE event_id % 5 WHEN 0 THEN 'de-DE,de;q=0.9' WHEN 1 THEN 'en-US;q=0.9,en'
    WHEN 2 THEN 'zh-Hant-TW' WHEN 3 THEN 'fr' ELSE NULL END AS accept_language,
  CASE WHEN event_id % 13 = 0 THEN 'nl' ELSE NULL END AS cdn_country, ts AS created_at
FROM events""",
    "processing_jobs": """SELECT o_orderkey AS id, o_orderpriority AS tool,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'queued' END AS status,
  CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS user_id,
  CAST(o_orderkey % 101 AS INT) AS progress,
  o_custkey % 2 = 1 AS is_returning, o_orderdate AS created_at FROM orders""",
    "event_jobs": """SELECT event_id AS id, event_type AS tool,
  CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'queued'
    WHEN 'signup' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status,
  user_id, CAST(user_id AS STRING) AS visitor_id,
  concat(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS session_id,
  ts AS created_at, ts AS finished_at,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS expires_at
FROM events""",
    "job_files": """SELECT l_orderkey AS job_id, l_partkey AS file_id,
  CASE l_linestatus WHEN 'O' THEN 'output' ELSE 'input' END AS role, l_linenumber AS position
FROM lineitem""",
    "stored_files": """SELECT p_partkey AS id, concat(p_name, '.pdf') AS original_name,
  CASE p_size % 3 WHEN 0 THEN 'upload' WHEN 1 THEN 'processed' ELSE 'thumbnail' END AS category,
  CASE p_size % 4 WHEN 0 THEN 'docx' ELSE 'pdf' END AS extension,
  CAST(p_size AS BIGINT) * 1024 AS size_bytes,
  CASE p_partkey % 7 WHEN 0 THEN 'deleted' WHEN 1 THEN 'expired' ELSE 'active' END AS status,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey END AS user_id,
  CASE WHEN p_partkey % 4 = 0 THEN NULL
    ELSE CAST(DATE '2024-01-01' + CAST(p_partkey % 60 AS INT) AS TIMESTAMP) END AS expires_at,
  CAST(DATE '2023-06-01' + CAST(p_partkey % 200 AS INT) AS TIMESTAMP) AS created_at
FROM part""",
    "users": """SELECT c_custkey AS id, c_name AS name,
  lower(concat(c_name, '@example.com')) AS email,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'pro' WHEN 'MACHINERY' THEN 'basic' ELSE 'free' END
    AS plan,
  CASE c_nationkey % 8 WHEN 0 THEN 'suspended' WHEN 1 THEN 'inactive' ELSE 'active' END AS status,
  CAST(DATE '2023-01-01' + CAST(c_custkey % 365 AS INT) AS TIMESTAMP) AS created_at
FROM customer""",
    "subscriptions": """SELECT c_custkey * 10 + n_nationkey % 3 AS id, c_custkey AS user_id,
  CASE n_nationkey % 2 WHEN 0 THEN 'pro' ELSE 'basic' END AS plan,
  CAST((c_nationkey + n_nationkey + 1) * 100 AS INT) AS price_cents,
  CASE c_custkey % 4 WHEN 0 THEN 'yearly' ELSE 'monthly' END AS billing_interval,
  CASE (c_nationkey + n_nationkey) % 4 WHEN 0 THEN 'expired' WHEN 1 THEN 'cancelled'
    ELSE 'active' END AS status,
  CASE WHEN c_custkey % 5 = 0 THEN NULL
    ELSE CAST(DATE '2024-02-01' + CAST(c_custkey % 90 AS INT) AS TIMESTAMP) END AS renews_at,
  CAST(DATE '2023-01-01' + CAST((c_custkey * 7 + n_nationkey * 31) % 300 AS INT) AS TIMESTAMP)
    AS created_at
FROM (SELECT *, 0 AS n_nationkey FROM customer UNION ALL SELECT *, 1 AS n_nationkey FROM customer
  UNION ALL SELECT *, 2 AS n_nationkey FROM customer) WHERE c_custkey % 3 = 0""",
    "feedback": """SELECT conv_id * 1000 + turn AS id,
  concat('User ', CAST(conv_id % 50 AS STRING)) AS name,
  concat('user', CAST(conv_id % 50 AS STRING), '@example.com') AS email,
  CASE conv_id % 3 WHEN 0 THEN NULL ELSE concat('Subject ', CAST(turn AS STRING)) END AS subject,
  CASE conv_id % 6 WHEN 0 THEN 'general' WHEN 1 THEN 'bug' WHEN 2 THEN 'feature'
    WHEN 3 THEN 'ui_ux' WHEN 4 THEN 'performance' ELSE 'other' END AS category,
  text AS message, turn % 4 = 0 AS is_read,
  CASE WHEN turn % 4 = 2 THEN text ELSE NULL END AS attachment_data,
  concat('10.0.0.', CAST(conv_id % 37 AS STRING)) AS client_ip,
  CAST(DATE '2024-01-01' + CAST(conv_id % 20 AS INT) AS TIMESTAMP) AS created_at
FROM conversations WHERE role = 'user'""",
    "error_events": """SELECT CAST(event_id AS STRING) AS id,
  concat('Error', CAST(user_id % 20 AS STRING)) AS exc_type,
  'app.py' AS file, concat('fn', CAST(user_id % 7 AS STRING)) AS function,
  concat('value ', CAST(event_id AS STRING)) AS message,
  concat('/', CAST(user_id AS STRING)) AS path, concat('trace ', CAST(event_id AS STRING)) AS stack,
  ts FROM events WHERE event_type = 'error'""",
    "requests": """SELECT event_id AS id, event_type AS bucket,
  concat('10.0.0.', CAST(user_id % 10 AS STRING)) AS client_ip,
  CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts FROM events""",
    "job_events": """SELECT user_id AS job_id,
  CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'processing'
    WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed'
    ELSE CASE event_id % 5 WHEN 0 THEN 'retry' WHEN 1 THEN 'expire' ELSE 'queued' END END AS kind,
  ts, event_id AS seq, CAST(event_id % 120 AS INT) AS progress,
  CASE event_type WHEN 'error' THEN concat('E', CAST(event_id % 9 AS STRING)) ELSE NULL END
    AS error_code
FROM events""",
    "tool_configs": """SELECT * FROM (VALUES
  ('1-URGENT', 'Urgent', 'Convert', 0), ('2-HIGH', 'High', 'Convert', 1),
  ('3-MEDIUM', 'Medium', 'Edit', 2), ('4-NOT SPECIFIED', 'Unspecified', 'Edit', 3),
  ('unused', 'Unused', 'Security', 4)) AS t(slug, name, category, sort_order)""",
}

# Pages of five lines, as the SQL side cuts them.
LINES_PER_PAGE = 5
SQL_PAGES = """SELECT doc_id, CAST(p + 1 AS INT) AS page_no,
  CAST(ceil(len(parts) / 5.0) AS INT) AS total_pages,
  array_to_string(list_slice(parts, p * 5 + 1, p * 5 + 5), chr(10)) AS text
FROM (SELECT doc_id, parts, unnest(range(0, CAST(ceil(len(parts) / 5.0) AS BIGINT))) AS p
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""
VIEWS["page_visits"] = f"""SELECT {_VISIT_COLUMNS},
  row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS STRING)) > 1
    AS is_returning, ts AS created_at FROM events"""


def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    table = configure(spark).read.parquet(f"{folder}/{name}.parquet")
    return table


@cache
def _sources(view: str) -> tuple[str, ...]:
    """Test tables a view reads."""
    words = set(VIEWS[view].replace("(", " ").replace(")", " ").split())
    return tuple(name for name in TABLES if name in words)


def doc_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents cut into pages of five lines, each document within its own row."""

    def total(lines):
        return F.ceil(F.size(lines) / LINES_PER_PAGE).cast("int")

    def cut(lines):
        def page(number):
            first = (number - 1) * LINES_PER_PAGE + 1
            return F.struct(
                number.alias("page_no"),
                total(lines).alias("total_pages"),
                F.array_join(F.slice(lines, first, LINES_PER_PAGE), "\n").alias("text"),
            )

        return F.transform(F.sequence(F.lit(1), total(lines)), page)

    pages = let(F.split("text", "\n"), cut)
    documents = raw(spark, folder, "documents")
    return documents.select("doc_id", F.explode(pages).alias("p")).select("doc_id", "p.*")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An adapter view as a DataFrame."""
    if name == "page_visits":
        return mark_returning(view(spark, folder, "plain_visits"))
    if name == "doc_pages":
        return doc_pages(spark, folder)
    configure(spark)
    text = VIEWS[name]
    frames = {}
    for table in _sources(name):
        frames[table] = raw(spark, folder, table)
        for before in ("FROM ", "JOIN "):
            text = text.replace(f"{before}{table}", f"{before}{{{table}}}")
    return spark.sql(text, **frames) if frames else spark.sql(text)


def stream_view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An adapter view over the table read as a stream of files."""
    (table,) = _sources(name)
    schema = raw(spark, folder, table).schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    )
    return spark.sql(VIEWS[name].replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: stream})


def with_views(query: str, *names: str) -> str:
    """SQL text of a query with the adapter views it needs as common table expressions."""
    parts = []
    for name in names:
        text = SQL_PAGES if name == "doc_pages" else VIEWS[name]
        parts.append(f"{name} AS ({text})")
    if not parts:
        return query
    head, rest = "WITH RECURSIVE ", query.strip()
    if rest.upper().startswith("WITH "):
        return head + ",\n".join(parts) + ",\n" + rest[5:]
    return head + ",\n".join(parts) + "\n" + rest
