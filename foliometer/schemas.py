"""Column layout of the product tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "bool": T.BooleanType(),
    "short": T.ShortType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "ts": T.TimestampType(),
    "binary": T.BinaryType(),
    "options": T.MapType(T.StringType(), T.StringType()),
}


def _table(required: str, optional: str = "") -> T.StructType:
    """Schema from ``name:type`` words; a word without a type is a string."""
    fields = []
    for words, nullable in ((required, False), (optional, True)):
        for word in words.split():
            name, _, kind = word.partition(":")
            fields.append(T.StructField(name, _TYPES[kind or "string"], nullable))
    return T.StructType(fields)


SCHEMAS = {
    "page_visits": _table(
        "id visitor_id session_id path is_returning:bool created_at:ts",
        "referrer device browser os country source",
    ),
    "raw_visits": _table(
        "id visitor_id session_id path created_at:ts",
        "referrer source user_agent accept_language cdn_country",
    ),
    "processing_jobs": _table(
        "id tool status progress:short options:options is_returning:bool created_at:ts",
        "user_id error_code error_message started_at:ts finished_at:ts expires_at:ts "
        "visitor_id session_id device browser os country source",
    ),
    "job_files": _table("job_id file_id role position:int"),
    "stored_files": _table(
        "id original_name stored_name category relative_path media_type extension "
        "size_bytes:long status created_at:ts",
        "checksum_sha256 user_id expires_at:ts",
    ),
    "users": _table(
        "id name email plan is_admin:bool status created_at:ts", "email_verified_at:ts avatar"
    ),
    "subscriptions": _table(
        "id user_id plan price_cents:int currency interval status provider payments_count:int "
        "created_at:ts",
        "started_at:ts renews_at:ts",
    ),
    "tool_configs": _table(
        "slug name category enabled:bool visible:bool maintenance:bool file_limit_mb:int "
        "sort_order:int"
    ),
    "feedback": _table(
        "id name email category message created_at:ts",
        "subject attachment_name attachment_content_type attachment_data:binary client_ip user_id",
    ),
    "contact_messages": _table(
        "id name email message is_read:bool created_at:ts", "subject reply replied_at:ts"
    ),
    "audit_logs": _table(
        "id action category summary created_at:ts",
        "actor_id actor_email entity_type entity_id ip meta",
    ),
    "error_logs": _table(
        "fingerprint level message count:long resolved:bool created_at:ts last_seen_at:ts",
        "service path stack",
    ),
    "error_events": _table("id exc_type message ts:ts", "file function path stack"),
    "app_settings": _table("key value category", "updated_by"),
    "requests": _table("id bucket client_ip ts:ts"),
    "upload_items": _table(
        "batch_id position:int filename size_bytes:long", "head:binary plan"
    ),
    "phase_events": _table("job_id phase seconds:double"),
    "job_events": _table("job_id kind ts:ts seq:long", "progress:int error_code"),
    "doc_pages": _table("doc_id page_no:int total_pages:int text"),
    "doc_spans": _table(
        "doc_id page_no:int span_no:int text rotation_deg:double alpha:double size_pt:double"
    ),
    "image_placements": _table(
        "doc_id page_no:int digest a:double b:double c:double d:double e:double f:double "
        "alpha:double has_smask:bool x0:double y0:double x1:double y1:double"
    ),
    # CMS tables: stored and scanned, no operators of their own.
    "announcements": _table("id title body status created_at:ts", "published_at:ts"),
    "faqs": _table("id question answer category published:bool sort_order:int created_at:ts"),
    "blog_posts": _table("id title slug body status created_at:ts", "excerpt author published_at:ts"),
    "content_pages": _table("id slug title body status created_at:ts"),
}
