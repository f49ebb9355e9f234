"""Scalar functions (E1-E25), filters (F1-F15) and option checks over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filenames, filetypes, filters, languages, measures, text, traffic
from ..functions import pages as page_functions
from ..operators.jobs import admit_jobs
from ..operators.options import validate_options
from .registry import query
from .testdata import EVENTS_NOW, FILES_NOW

# ---- E: scalar functions -----------------------------------------------------------


@query(
    "E1_user_agent",
    "id:s os:s device:s browser:s",
    "raw_visits",
    """SELECT id,
    CASE WHEN ua LIKE '%windows%' THEN 'Windows'
      WHEN (ua LIKE '%macintosh%' OR ua LIKE '%mac os x%')
        THEN CASE WHEN ua LIKE '%ipad%' OR ua LIKE '%iphone%' THEN 'iOS' ELSE 'macOS' END
      WHEN ua LIKE '%android%' THEN 'Android'
      WHEN ua LIKE '%iphone%' OR ua LIKE '%ipad%' OR ua LIKE '%ipod%' THEN 'iOS'
      WHEN ua LIKE '%linux%' THEN 'Linux' ELSE 'Other' END AS os,
    CASE WHEN ua LIKE '%mobi%' OR ua LIKE '%iphone%' OR ua LIKE '%ipod%' THEN 'Mobile'
      WHEN ua LIKE '%ipad%' OR ua LIKE '%tablet%' OR ua LIKE '%playbook%' OR ua LIKE '%kindle%'
        OR ua LIKE '%android%' THEN 'Tablet' ELSE 'Desktop' END AS device,
    CASE WHEN ua LIKE '%opera%' OR ua LIKE '%opr/%' THEN 'Opera'
      WHEN ua LIKE '%edge%' OR ua LIKE '%edg/%' THEN 'Edge'
      WHEN ua LIKE '%chrome%' OR ua LIKE '%crios%' THEN 'Chrome'
      WHEN ua LIKE '%firefox%' OR ua LIKE '%fxios%' THEN 'Firefox'
      WHEN ua LIKE '%safari%' AND ua NOT LIKE '%chromium%' THEN 'Safari' ELSE 'Other' END AS browser
    FROM (SELECT id, lower(coalesce(user_agent, '')) AS ua FROM raw_visits)""",
)
def _user_agent(t):
    return t.raw_visits.select("id", traffic.user_agent("user_agent").alias("a")).select("id", "a.*")


@query(
    "E2_country",
    "id:s country:s",
    "raw_visits",
    """SELECT id, CASE WHEN coalesce(cdn_country, '') <> '' THEN upper(cdn_country)
      WHEN tag LIKE '%-%' AND length(region) = 2 THEN region ELSE 'US' END AS country
    FROM (SELECT *, upper(list_last(string_split(tag, '-'))) AS region
      FROM (SELECT *, trim(split_part(accept_language, ',', 1)) AS tag FROM raw_visits))""",
)
def _country(t):
    return t.raw_visits.select("id", traffic.country("accept_language", "cdn_country").alias("country"))


@query(
    "E3_source",
    "id:s source:s",
    "raw_visits",
    """SELECT id, CASE WHEN coalesce(source, '') <> '' THEN source
      WHEN coalesce(referrer, '') = '' THEN 'Direct'
      WHEN r LIKE '%google%' THEN 'Organic Search'
      WHEN r LIKE '%facebook%' OR r LIKE '%t.co%' OR r LIKE '%twitter%' OR r LIKE '%instagram%'
        OR r LIKE '%linkedin%' THEN 'Social Media'
      WHEN r LIKE '%github%' OR r LIKE '%reddit%' THEN 'Referral'
      WHEN r LIKE '%ads%' THEN 'Paid Ads' ELSE 'Referral' END AS source
    FROM (SELECT *, lower(referrer) AS r FROM raw_visits)""",
)
def _source(t):
    return t.raw_visits.select("id", traffic.visit_source("source", "referrer").alias("source"))


@query(
    "E4_trend_labels",
    "id:s yearly:s monthly:s weekly:s daily:s",
    "processing_jobs",
    """SELECT id, strftime(created_at, '%Y') AS yearly, strftime(created_at, '%b %Y') AS monthly,
    concat('Wk ', week(monday), ' (', year(monday), ')') AS weekly,
    strftime(created_at, '%b %d') AS daily
    FROM (SELECT *, date_trunc('week', created_at) AS monday FROM processing_jobs)""",
)
def _labels(t):
    units = ("yearly", "monthly", "weekly", "daily")
    return t.processing_jobs.select(
        "id",
        *[
            measures.trend_label(measures.trend_bucket("created_at", unit), unit).alias(unit)
            for unit in units
        ],
    )


@query(
    "E5_slugify",
    "id:i slug:s",
    "feedback",
    """SELECT id, CASE WHEN slug = '' THEN substr(sha256(CAST(id AS VARCHAR)), 1, 8) ELSE slug END
    AS slug FROM (SELECT id, regexp_replace(regexp_replace(lower(trim(message)), '[^a-z0-9]+',
      '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM feedback)""",
)
def _slugify(t):
    return t.feedback.select("id", text.slugify("message", "id").alias("slug"))


_NAMES = """SELECT p_partkey AS id, concat(CASE p_partkey % 6 WHEN 0 THEN '../../up/'
    WHEN 1 THEN 'C:' || chr(92) || 'in' || chr(92) WHEN 2 THEN 'a<b>' WHEN 3 THEN ' .'
    WHEN 4 THEN 'x|y?' ELSE '' END, p_name, CASE p_partkey % 5 WHEN 0 THEN '.PDF'
    WHEN 1 THEN '.tar.gz' WHEN 2 THEN '' WHEN 3 THEN '.' ELSE '.docx' END) AS path FROM part"""


def _named(t):
    part = t.raw("part")
    head = (
        F.when(F.col("p_partkey") % 6 == 0, "../../up/")
        .when(F.col("p_partkey") % 6 == 1, "C:\\in\\")
        .when(F.col("p_partkey") % 6 == 2, "a<b>")
        .when(F.col("p_partkey") % 6 == 3, " .")
        .when(F.col("p_partkey") % 6 == 4, "x|y?")
        .otherwise("")
    )
    tail = (
        F.when(F.col("p_partkey") % 5 == 0, ".PDF")
        .when(F.col("p_partkey") % 5 == 1, ".tar.gz")
        .when(F.col("p_partkey") % 5 == 2, "")
        .when(F.col("p_partkey") % 5 == 3, ".")
        .otherwise(".docx")
    )
    return part.select(F.col("p_partkey").alias("id"), F.concat(head, "p_name", tail).alias("path"))


_BASE = r"regexp_extract(regexp_replace(path, '^.:', ''), '([^/\\]*)$', 1)"


@query(
    "E6_sanitize_filename",
    "id:i name:s",
    "",
    rf"""SELECT id, regexp_replace(regexp_replace({_BASE}, '[<>:"/\\|?*]', '_', 'g'),
      '^[ .]+|[ .]+$', '', 'g') AS name FROM ({_NAMES})""",
)
def _sanitize(t):
    return _named(t).select("id", filenames.sanitize_filename("path").alias("name"))


@query(
    "E7_file_extension",
    "id:i extension:s stem:s",
    "",
    rf"""SELECT id, lower(regexp_extract({_BASE}, '^.+\.([^.]+)$', 1)) AS extension,
    regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\.[^.]+$', '\1') AS stem
    FROM ({_NAMES})""",
)
def _extension(t):
    return _named(t).select(
        "id",
        filenames.file_extension("path").alias("extension"),
        filenames.file_stem("path").alias("stem"),
    )


@query(
    "E8_human_size",
    "id:i size:s",
    "",
    """SELECT p_partkey AS id, CASE WHEN n < 1024 THEN concat(n, ' B')
      WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE)
      WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE)
      WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE)
      ELSE printf('%.1f TB', n / 1099511627776.0::DOUBLE) END AS size
    FROM (SELECT p_partkey, CAST(p_size AS BIGINT) * CAST(CASE p_partkey % 5 WHEN 0 THEN 7
      WHEN 1 THEN 640 WHEN 2 THEN 777777 WHEN 3 THEN 33333333333 ELSE 98765432 END AS BIGINT)
      AS n FROM part)""",
)
def _human_size(t):
    factor = F.element_at(
        F.array(*[F.lit(n).cast("long") for n in (7, 640, 777777, 33333333333, 98765432)]),
        (F.col("p_partkey") % 5 + 1).cast("int"),
    )
    size = F.col("p_size").cast("long") * factor
    return t.raw("part").select(F.col("p_partkey").alias("id"), measures.human_size(size).alias("size"))


@query(
    "E10_fingerprint",
    "id:s fingerprint:s",
    "error_events",
    """SELECT id, substr(sha256(concat(exc_type, ':', file, ':', function)), 1, 32)
    AS fingerprint FROM error_events""",
)
def _fingerprint(t):
    return t.error_events.select(
        "id", text.error_fingerprint("exc_type", "file", "function").alias("fingerprint")
    )


@query(
    "E11_truncations",
    "id:i message:s stack:i job_message:i",
    "",
    """SELECT doc_id AS id, substr(text, 1, 500) AS message, least(length(text), 8000) AS stack,
    least(length(text), 2000) AS job_message FROM documents""",
)
def _truncations(t):
    return t.raw("documents").select(
        F.col("doc_id").alias("id"),
        text.truncate("text", 500).alias("message"),
        F.length(text.truncate("text", 8000)).alias("stack"),
        F.length(text.truncate("text", 2000)).alias("job_message"),
    )


@query(
    "E12_growth_and_share",
    "id:i growth:f share:f",
    "processing_jobs",
    """SELECT id, CASE WHEN id % 7 = 0 THEN 0.0
      ELSE round((progress - id % 7) / (id % 7) * 100, 1) END AS growth,
    CASE WHEN id % 7 = 0 THEN 0.0 ELSE round(progress * 100.0 / (id % 7), 1) END AS share
    FROM processing_jobs""",
)
def _growth(t):
    base = F.col("id") % 7
    return t.processing_jobs.select(
        "id",
        measures.growth_pct(F.col("progress"), base).alias("growth"),
        measures.share_pct(F.col("progress"), base).alias("share"),
    )


_HEADS = """SELECT doc_id AS id, concat('f.', CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx'
    WHEN 2 THEN 'jpg' WHEN 3 THEN 'png' ELSE 'exe' END) AS name,
    CASE (doc_id // 5) % 6 WHEN 0 THEN encode('junk %PDF-1.7' || text)
      WHEN 1 THEN from_hex('504B0304') || encode(text)
      WHEN 2 THEN from_hex('D0CF11E0A1B11AE1') || encode(text)
      WHEN 3 THEN from_hex('FFD8FF') || encode(text)
      WHEN 4 THEN from_hex('89504E470D0A1A0A') || encode(text) ELSE encode(text) END AS head
    FROM documents"""


def _heads(t):
    kind = F.floor(F.col("doc_id") / 5) % 6
    extension = F.element_at(
        F.array(*[F.lit(e) for e in ("pdf", "docx", "jpg", "png", "exe")]),
        (F.col("doc_id") % 5 + 1).cast("int"),
    )
    body = F.encode("text", "UTF-8")
    head = F.when(kind == 0, F.concat(F.lit(b"junk %PDF-1.7"), body))
    for number, mark in enumerate(
        ("504B0304", "D0CF11E0A1B11AE1", "FFD8FF", "89504E470D0A1A0A"), start=1
    ):
        head = head.when(kind == number, F.concat(F.lit(bytes.fromhex(mark)), body))
    return t.raw("documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("f."), extension).alias("name"),
        head.otherwise(body).alias("head"),
    )


@query(
    "E13_sniff",
    "id:i media_type:s error:s",
    "",
    f"""SELECT id, CASE WHEN ok THEN media END AS media_type, CASE WHEN media IS NULL THEN
      'unsupported' WHEN NOT ok THEN 'corrupted' END AS error FROM (
    SELECT id, CASE e WHEN 'pdf' THEN 'application/pdf' WHEN 'docx' THEN
      'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
      WHEN 'jpg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' END AS media,
      CASE e WHEN 'pdf' THEN hex(head[1:1024]) LIKE '%255044462D%'
        WHEN 'docx' THEN hex(head[1:8]) LIKE '504B0304%' OR hex(head[1:8]) = 'D0CF11E0A1B11AE1'
        WHEN 'jpg' THEN hex(head[1:3]) = 'FFD8FF'
        WHEN 'png' THEN hex(head[1:8]) = '89504E470D0A1A0A' ELSE false END AS ok
    FROM (SELECT *, regexp_extract(name, '([a-z]+)$', 1) AS e FROM ({_HEADS})))""",
)
def _sniff(t):
    return _heads(t).select("id", filetypes.sniff("name", "head").alias("r")).select("id", "r.*")


@query(
    "E14_check_attachment",
    "id:i problem:s",
    "",
    f"""SELECT id, CASE WHEN kind = 'text/plain' THEN 'unsupported_type'
      WHEN octet_length(head) = 0 THEN 'empty' WHEN octet_length(head) > 1048576 THEN 'too_large'
      WHEN kind = 'image/jpeg' AND hex(head[1:3]) <> 'FFD8FF' THEN 'not_an_image'
      WHEN kind = 'image/png' AND hex(head[1:8]) <> '89504E470D0A1A0A' THEN 'not_an_image' END
      AS problem
    FROM (SELECT *, CASE id % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png'
      ELSE 'text/plain' END AS kind FROM ({_HEADS}))""",
)
def _attachment(t):
    kind = (
        F.when(F.col("id") % 3 == 0, "image/JPEG; q=1")
        .when(F.col("id") % 3 == 1, "image/png")
        .otherwise("text/plain")
    )
    return _heads(t).select("id", filetypes.check_attachment(kind, "head").alias("problem"))


@query(
    "E15_plan_limits",
    "id:i max_files:i max_file_bytes:i max_total_bytes:i",
    "users",
    """SELECT id, CASE plan WHEN 'pro' THEN 100 WHEN 'basic' THEN 50 ELSE 20 END AS max_files,
    CASE plan WHEN 'pro' THEN 1024 WHEN 'basic' THEN 500 ELSE 50 END * 1048576 AS max_file_bytes,
    CASE plan WHEN 'pro' THEN 1024 WHEN 'basic' THEN 500 ELSE 50 END * 1048576 AS max_total_bytes
    FROM users""",
)
def _limits(t):
    plan = F.when(F.col("plan") == "free", F.lit(None)).otherwise(F.upper("plan"))
    return t.users.select("id", measures.plan_limits(plan).alias("l")).select("id", "l.*")


@query(
    "E16_feedback_label",
    "id:i label:s",
    "feedback",
    """SELECT id, CASE category WHEN 'general' THEN 'General Feedback' WHEN 'bug' THEN 'Bug Report'
    WHEN 'feature' THEN 'Feature Request' WHEN 'ui_ux' THEN 'UI/UX Suggestion'
    WHEN 'performance' THEN 'Performance Issue' ELSE 'Other' END AS label FROM feedback""",
)
def _label(t):
    return t.feedback.select("id", measures.feedback_label("category").alias("label"))


@query(
    "E17_client_ip",
    "id:i ip:s",
    "feedback",
    """SELECT id, CASE id % 3 WHEN 0 THEN concat('203.0.113.', CAST(id % 200 AS VARCHAR))
    ELSE client_ip END AS ip FROM feedback""",
)
def _client_ip(t):
    forwarded = F.when(
        F.col("id") % 3 == 0,
        F.concat(F.lit(" 203.0.113."), (F.col("id") % 200).cast("string"), F.lit(" , 10.1.1.1")),
    ).when(F.col("id") % 3 == 1, "")
    return t.feedback.select("id", text.client_ip(forwarded, "client_ip").alias("ip"))


@query(
    "E18_scrub_options",
    "id:i password:s mode:s",
    "users",
    "SELECT id, '[redacted]' AS password, plan AS mode FROM users",
)
def _scrub(t):
    options = F.create_map(F.lit("password"), F.col("name"), F.lit("mode"), F.col("plan"))
    scrubbed = text.scrub_options(options, ("user_password", "owner_password", "password"))
    return t.users.select("id", scrubbed.alias("o")).select(
        "id", F.col("o")["password"].alias("password"), F.col("o")["mode"].alias("mode")
    )


@query(
    "E19_normal_email",
    "id:i email:s",
    "users",
    "SELECT id, lower(name) || '@example.com' AS email FROM users",
)
def _email(t):
    raw_email = F.concat(F.lit("  "), F.upper("email"), F.lit(" \t"))
    return t.users.select("id", text.normal_email(raw_email).alias("email"))


@query(
    "E20_progress",
    "id:i clamped:i stepped:i",
    "processing_jobs",
    """SELECT id, greatest(0, least(100, progress * 2 - 50)) AS clamped,
    floor((progress % 7 + 1) / 7 * 90) AS stepped FROM processing_jobs""",
)
def _progress(t):
    done = (F.col("progress") % 7 + 1).cast("int")
    return t.processing_jobs.select(
        "id",
        measures.clamp_progress(F.col("progress") * 2 - 50).alias("clamped"),
        measures.step_progress(done, F.lit(7)).alias("stepped"),
    )


@query(
    "E21_fill_template",
    "doc_id:i page_no:i line:s",
    "doc_pages",
    """SELECT doc_id, page_no, concat('doc', doc_id, ' p. ', page_no, '/', total_pages,
    ' 2024-01-31 14:05') AS line FROM doc_pages""",
)
def _template(t):
    line = page_functions.fill_template(
        "{filename} p. {page}/{total} {date} {time}",
        F.col("page_no"),
        F.col("total_pages"),
        "2024-01-31 14:05:59",
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")),
    )
    return t.doc_pages.select("doc_id", "page_no", line.alias("line"))


_SPECS = """SELECT doc_id, total, CASE doc_id % 6 WHEN 0 THEN '1, 2-3' WHEN 1 THEN 'a-b'
    WHEN 2 THEN '3-1' WHEN 3 THEN '2,1,2' WHEN 4 THEN concat('1-', CAST(total AS VARCHAR))
    ELSE '0-2' END AS spec
    FROM (SELECT doc_id, CAST(ceil(len(string_split(text, chr(10))) / 5.0) AS INT) AS total
      FROM documents)"""


def _specs(t):
    lines = F.size(F.split("text", "\n"))
    total = F.ceil(lines / 5).cast("int")
    kind = F.col("doc_id") % 6
    spec = (
        F.when(kind == 0, "1, 2-3")
        .when(kind == 1, "a-b")
        .when(kind == 2, "3-1")
        .when(kind == 3, "2,1,2")
        .when(kind == 4, F.concat(F.lit("1-"), total.cast("string")))
        .otherwise("0-2")
    )
    return t.raw("documents").select("doc_id", total.alias("total"), spec.alias("spec"))


@query(
    "E22_page_selection",
    "doc_id:i pages:s error:s",
    "",
    f"""SELECT doc_id, CASE WHEN error IS NULL THEN array_to_string(CASE doc_id % 6
      WHEN 0 THEN [1, 2, 3] WHEN 3 THEN [2, 1, 2] ELSE range(1, total + 1) END, ',') END AS pages,
      error FROM (SELECT *, CASE doc_id % 6 WHEN 1 THEN 'invalid' WHEN 2 THEN 'empty'
      WHEN 5 THEN 'out_of_range' WHEN 0 THEN CASE WHEN total < 3 THEN 'out_of_range' END
      WHEN 3 THEN CASE WHEN total < 2 THEN 'out_of_range' END END AS error FROM ({_SPECS}))""",
)
def _selection(t):
    return _specs(t).select(
        "doc_id",
        F.array_join(page_functions.select_pages("spec", "total").cast("array<string>"), ",").alias(
            "pages"
        ),
        page_functions.selection_error("spec", "total").alias("error"),
    )


@query(
    "E23_page_predicate",
    "doc_id:i page_no:i chosen:b",
    "doc_pages",
    """SELECT doc_id, page_no, CASE doc_id % 6 WHEN 0 THEN true WHEN 1 THEN page_no = 1
      WHEN 2 THEN page_no = total_pages WHEN 3 THEN page_no % 2 = 1 WHEN 4 THEN page_no % 2 = 0
      ELSE page_no BETWEEN 2 AND 3 OR page_no = 5 END AS chosen FROM doc_pages""",
)
def _predicate(t):
    modes = F.array(*[F.lit(m) for m in ("all", "first", "last", "odd", "even", "custom")])
    mode = F.element_at(modes, (F.col("doc_id") % 6 + 1).cast("int"))
    ranges = F.when(F.col("doc_id") % 6 == 5, "2-3, 5")
    chosen = page_functions.page_matches(mode, ranges, "page_no", "total_pages")
    return t.doc_pages.select("doc_id", "page_no", chosen.alias("chosen"))


@query(
    "E24_language_list",
    "doc_id:i error:s",
    "",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'duplicate' WHEN 2 THEN
    'too_many' WHEN 3 THEN 'unsupported' ELSE NULL END AS error FROM documents""",
)
def _language_list(t):
    lists = ("eng+deu", "eng+eng", "eng+deu+fra+spa+ita", "eng+klingon", "chi_sim")
    spec = F.element_at(
        F.array(*[F.lit(item) for item in lists]), (F.col("doc_id") % 5 + 1).cast("int")
    )
    return t.raw("documents").select("doc_id", languages.language_list_error(spec).alias("error"))


@query(
    "E25_compact",
    "doc_id:i n:i digest:s",
    "",
    r"""SELECT doc_id, length(c) AS n, sha256(c) AS digest FROM (
    SELECT doc_id, lower(regexp_replace(text, '[\s\p{Z}\x{0b}\x{85}]+', '', 'g')) AS c
    FROM documents)""",
)
def _compact(t):
    return t.raw("documents").select("doc_id", text.compact("text").alias("c")).select(
        "doc_id", F.length("c").alias("n"), F.sha2("c", 256).alias("digest")
    )


# ---- F: filters ----------------------------------------------------------------------


def _simple(name, columns, views, where, build, source):
    names = ", ".join(word.split(":")[0] for word in columns.split())
    query(name, columns, views, f"SELECT {names} FROM {source} WHERE {where}")(build)


_simple(
    "F1_optional_equals", "id:i email:s", "users", "plan = 'pro'",
    lambda t: filters.optional_equals(t.users, plan="pro", status="", name=None), "users",
)
_simple(
    "F2_ignore_case", "id:s device:s", "plain_visits", "device = 'Mobile' AND country = 'DE'",
    lambda t: filters.optional_equals_ignore_case(t.plain_visits, device="MOBILE", country="de"),
    "plain_visits",
)
_simple(
    "F3_search", "id:i email:s", "feedback",
    r"""lower(name) LIKE '%user_1%' ESCAPE '\' OR lower(message) LIKE '%user_1%' ESCAPE '\'
    OR lower(email) LIKE '%user_1%' ESCAPE '\'""",
    lambda t: filters.search(t.feedback, ("name", "email", "message"), "USER_1"), "feedback",
)
_simple(
    "F4_date_range", "id:s created_at:t", "plain_visits",
    "created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-11'",
    lambda t: filters.in_date_range(t.plain_visits, "created_at", "bad", "2024-01-10", EVENTS_NOW)
    .filter(F.col("created_at") >= filters.timestamp("2024-01-01")),
    "plain_visits",
)
_simple(
    "F5_visitor_type", "id:s visitor_id:s", "page_visits", "NOT is_returning",
    lambda t: filters.visitor_type(t.page_visits, "unique"), "page_visits",
)
_simple(
    "F6_one_of", "id:i status:s", "event_jobs", "status IN ('queued', 'pending')",
    lambda t: filters.one_of(t.event_jobs, "status", ["queued", "pending"]), "event_jobs",
)
_simple(
    "F7_expired_files", "id:i expires_at:t", "stored_files",
    "status = 'active' AND expires_at IS NOT NULL AND expires_at < TIMESTAMP '2024-01-31'",
    lambda t: t.stored_files.filter(filters.expired_file(FILES_NOW)), "stored_files",
)
_simple(
    "F8_expired_jobs", "id:i status:s", "event_jobs",
    "status IN ('completed', 'failed', 'cancelled') AND expires_at < TIMESTAMP '2024-01-15'",
    lambda t: t.event_jobs.filter(filters.expired_job("2024-01-15 00:00:00")), "event_jobs",
)
_simple(
    "F9_anonymous_files", "id:i original_name:s", "stored_files",
    "user_id IS NOT DISTINCT FROM NULL",
    lambda t: t.stored_files.filter(filters.owned_by(None)), "stored_files",
)
_simple(
    "F10_downloadable", "id:i original_name:s", "stored_files",
    """status = 'active' AND user_id IS NULL
    AND (expires_at IS NULL OR expires_at >= TIMESTAMP '2024-01-31')""",
    lambda t: t.stored_files.filter(filters.downloadable(FILES_NOW, None)), "stored_files",
)
_simple(
    "F11_paying", "id:i plan:s", "users", "plan <> 'free'",
    lambda t: filters.paying(t.users), "users",
)
_simple(
    "F12_unread_only", "id:i email:s", "feedback", "NOT is_read",
    lambda t: filters.unread_only(t.feedback, True), "feedback",
)


@query(
    "F13_has_attachment",
    "id:i has_attachment:b",
    "feedback",
    "SELECT id, attachment_data IS NOT NULL AS has_attachment FROM feedback",
)
def _has_attachment(t):
    return t.feedback.select("id", filters.has_attachment().alias("has_attachment"))


@query(
    "F14_option_errors",
    "doc_id:i tool:s errors:s valid:b",
    "",
    """SELECT doc_id, tool, errors, errors = '' AS valid FROM (
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'rotate' WHEN 1 THEN 'header-footer'
      WHEN 2 THEN 'page-numbers' ELSE 'delete-pages' END AS tool,
    CASE doc_id % 4
      WHEN 0 THEN concat_ws(',', CASE WHEN n_chars % 2 = 1 THEN 'angle_choice' END,
        CASE WHEN n_chars % 3 = 0 THEN 'pages_pattern' END)
      WHEN 1 THEN concat_ws(',', CASE WHEN n_chars % 2 = 1 THEN 'pages_choice' END,
        CASE WHEN n_chars % 50 NOT BETWEEN 6 AND 36 THEN 'font_size_range' END,
        CASE WHEN length(text) > 200 THEN 'header_text_length' END,
        CASE WHEN n_chars % 2 = 0 THEN 'page_range_required' END)
      WHEN 2 THEN CASE WHEN n_chars % 2 = 1 THEN 'format_page' ELSE '' END
      ELSE CASE WHEN n_chars % 3 = 0 THEN 'pages_required' ELSE '' END END AS errors
    FROM documents)""",
)
def _option_errors(t):
    odd, third = F.col("n_chars") % 2 == 1, F.col("n_chars") % 3 == 0

    def options(*pairs):
        return F.create_map(*[F.lit(p) if isinstance(p, str) else p for p in pairs])

    kind = F.col("doc_id") % 4
    requests = t.raw("documents").select(
        "doc_id",
        F.element_at(
            F.array(*[F.lit(x) for x in ("rotate", "header-footer", "page-numbers", "delete-pages")]),
            (kind + 1).cast("int"),
        ).alias("tool"),
        F.when(
            kind == 0,
            options(
                "angle", F.when(odd, "45").otherwise("90"),
                "pages", F.when(third, "x").otherwise("1, 3-5"),
            ),
        )
        .when(
            kind == 1,
            options(
                "header_text", F.col("text"),
                "font_size", (F.col("n_chars") % 50).cast("string"),
                "pages", F.when(odd, "some").otherwise("custom"),
            ),
        )
        .when(kind == 2, options("format", F.when(odd, "p. {n}").otherwise("{page}")))
        .otherwise(options("pages", F.when(~third, "2"), "other", F.lit("x")))
        .alias("options"),
    )
    return validate_options(requests).withColumn("errors", F.array_join("errors", ","))


@query(
    "F15_admit_jobs",
    "request_id:i n_files:i total_bytes:i admitted:b reason:s",
    "job_files stored_files processing_jobs",
    """WITH links AS (
      SELECT l.job_id, l.file_id, l.position * 1000000 + l.file_id AS position
      FROM job_files l WHERE l.role = 'input'),
    checked AS (SELECT l.job_id, l.position, f.size_bytes,
      CASE WHEN f.id IS NULL OR f.status <> 'active' OR f.user_id IS NULL THEN 'not_found'
        WHEN f.extension <> 'pdf' THEN 'unsupported_type' END AS problem
      FROM links l LEFT JOIN stored_files f ON l.file_id = f.id),
    agg AS (SELECT job_id, count(*) AS n, sum(size_bytes) AS bytes,
      arg_min(problem, position) FILTER (problem IS NOT NULL) AS problem
      FROM checked GROUP BY job_id)
    SELECT j.id AS request_id, coalesce(a.n, 0) AS n_files, coalesce(a.bytes, 0) AS total_bytes,
      reason IS NULL AS admitted, reason
    FROM (SELECT j.id, a.n, a.bytes, CASE WHEN coalesce(a.n, 0) NOT BETWEEN 2 AND 4
        THEN 'file_count' ELSE a.problem END AS reason
      FROM processing_jobs j LEFT JOIN agg a ON a.job_id = j.id) q
    JOIN processing_jobs j ON j.id = q.id LEFT JOIN agg a ON a.job_id = j.id""",
)
def _admit(t):
    files = t.stored_files.withColumn(
        "user_id", F.when(F.col("user_id").isNotNull(), F.lit(1).cast("long"))
    )
    requests = t.processing_jobs.select(
        F.col("id").alias("request_id"),
        "tool",
        F.lit(1).cast("long").alias("user_id"),
        F.lit("pro").alias("plan"),
    )
    links = t.job_files.filter("role = 'input'").select(
        F.col("job_id").alias("request_id"),
        (F.col("position") * 1000000 + F.col("file_id")).alias("position"),
        "file_id",
    )
    # Every tool of the test data: two to four PDF files.
    profile = requests.select("tool").distinct().select(
        "tool",
        F.lit(2).alias("min_files"),
        F.lit(4).alias("max_files"),
        F.array(F.lit("pdf")).alias("extensions"),
    )
    return admit_jobs(requests, links, files, profile)
