"""Paged listings as one operator driven by a specification per table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.filters import has_attachment, optional_equals, search, timestamp, unread_only
from ..functions.measures import enum_rank
from ..session import cut_lineage
from .dashboard import page_counts, rows_per_user
from .jobs import latest_tool_of_file, names_of, naming_files, with_subscriber, with_user_email

DEFAULT_SIZE = 20
MAX_SIZE = 100
# Job ids that may be broadcast to filter the table of jobs: a few megabytes.
BROADCAST_LINKS = 100_000


@dataclass(frozen=True)
class Listing:
    """What may be filtered, searched and sorted in one listing."""

    searched: tuple[str, ...] = ()
    filtered: tuple[str, ...] = ()
    sorts: dict[str, Callable[[], Column]] = field(default_factory=dict)
    default_sort: str = "-created_at"
    fixed_order: tuple[str, ...] = ()
    key: str = "id"


def _column(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


LISTINGS = {
    "users": Listing(
        searched=("name", "email"),
        filtered=("plan", "status"),
        sorts={
            "name": _column("name"),
            "conversions": _column("conversions"),
            "created_at": _column("created_at"),
        },
    ),
    "subscriptions": Listing(
        searched=("user_name", "user_email"),
        filtered=("status",),
        sorts={
            "user": _column("user_name"),
            "price": _column("price_cents"),
            "renews_at": _column("renews_at"),
            "created_at": _column("created_at"),
        },
    ),
    "files": Listing(
        searched=("original_name",),
        filtered=("category",),
        sorts={
            "name": _column("original_name"),
            "size": _column("size_bytes"),
            "created_at": _column("created_at"),
        },
    ),
    "jobs": Listing(
        searched=("tool",),
        filtered=("status",),
        sorts={
            "tool": _column("tool"),
            "status": lambda: enum_rank("status", C.JOB_STATUSES),
            "progress": _column("progress"),
            "created_at": _column("created_at"),
        },
    ),
    "feedback": Listing(
        searched=("name", "email", "message"),
        filtered=("category",),
        fixed_order=("-created_at",),
    ),
    "messages": Listing(searched=("name", "email", "subject"), fixed_order=("-created_at",)),
    "audit": Listing(
        searched=("summary", "action"), filtered=("category",), fixed_order=("-created_at",)
    ),
    "errors": Listing(
        searched=("message",),
        filtered=("level",),
        fixed_order=("resolved", "-created_at"),
        key="fingerprint",
    ),
}


def ordering(expression: Column, descending: bool) -> Column:
    """NULL sorts as the largest value: last ascending, first descending."""
    return expression.desc_nulls_first() if descending else expression.asc_nulls_last()


def sort_columns(spec: Listing, sort: str | None) -> list[Column]:
    """Whitelisted sort key, ``-`` for descending; an unknown one means the default.

    The row key is appended, so that pages do not depend on the order of arrival.
    """
    if spec.fixed_order:
        names = list(spec.fixed_order)
        chosen = {name.lstrip("-"): _column(name.lstrip("-")) for name in names}
    else:
        known = {*spec.sorts, *(f"-{name}" for name in spec.sorts)}
        names = [sort if sort in known else spec.default_sort]
        chosen = spec.sorts
    columns = [ordering(chosen[name.lstrip("-")](), name.startswith("-")) for name in names]
    return [*columns, F.col(spec.key).asc()]


def filtered(df: DataFrame, spec: Listing, q: str | None = None, **values) -> DataFrame:
    """Equality filters and search of a listing, before sorting and paging."""
    chosen = {name: values.get(name) for name in spec.filtered}
    return search(optional_equals(df, **chosen), spec.searched, q)


def page_of(df: DataFrame, order, page: int = 1, size: int = DEFAULT_SIZE) -> DataFrame:
    """O2: one page; page numbers start at 1, sizes lie within 1 and 100."""
    if page < 1 or not 1 <= size <= MAX_SIZE:
        raise ValueError("page must be at least 1 and size between 1 and 100")
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def listing(
    df: DataFrame,
    name: str,
    q: str | None = None,
    sort: str | None = None,
    page: int = 1,
    size: int = DEFAULT_SIZE,
    unread: bool | None = None,
    **values,
) -> tuple[DataFrame, DataFrame]:
    """A page of a listing, and its total (``total``, ``pages``) without a sort."""
    spec = LISTINGS[name]
    rows = filtered(df, spec, q, **values)
    if name == "messages":
        rows = unread_only(rows, unread)
    return page_of(rows, sort_columns(spec, sort), page, size), page_counts(rows, size)


def _top_first(df: DataFrame, name: str, sort, page: int, size: int, q, **values) -> DataFrame:
    """A page whose sort key needs no look-up, cut before the look-ups run.

    Its few rows are stored where several look-ups use them, so the table is read once.
    """
    spec = LISTINGS[name]
    return page_of(filtered(df, spec, q, **values), sort_columns(spec, sort), page, size)


def _of_page(df: DataFrame, column: str, page: DataFrame, key: str) -> DataFrame:
    """Rows of a table that a page refers to.

    A page has at most 100 rows, so its keys can be sent to every task and the table
    is filtered where it is read.
    """
    keys = F.broadcast(page.select(F.col(key).alias(column)))
    return df.join(keys, column, "left_semi")


def list_users(users, jobs, q=None, sort=None, page=1, size=DEFAULT_SIZE, **values):
    """Users with their number of jobs.

    Only a sort by that number needs it for every user; otherwise it is counted
    for the users of the page.
    """
    if (sort or "").lstrip("-") == "conversions":
        counted = users.join(rows_per_user(jobs, "conversions"), "id", "left")
        rows = counted.na.fill(0, ["conversions"])
        return _top_first(rows, "users", sort, page, size, q, **values)
    top = cut_lineage(_top_first(users, "users", sort, page, size, q, **values))
    counts = rows_per_user(_of_page(jobs, "user_id", top, "id"), "conversions")
    rows = top.join(counts, "id", "left").na.fill(0, ["conversions"])
    return rows.orderBy(*sort_columns(LISTINGS["users"], sort))


def list_subscriptions(subscriptions, users, q=None, sort=None, page=1, size=DEFAULT_SIZE, **v):
    """Subscriptions with the subscriber's name and e-mail."""
    joined = with_subscriber(subscriptions, users)
    return _top_first(joined, "subscriptions", sort, page, size, q, **v)


def list_files(files, users, job_files, jobs, q=None, sort=None, page=1, size=DEFAULT_SIZE, **v):
    """Files with owner and latest tool, looked up for one page only."""
    top = cut_lineage(_top_first(files, "files", sort, page, size, q, **v))
    links = cut_lineage(_of_page(job_files.select("job_id", "file_id"), "file_id", top, "id"))
    # Files of a page may belong to any number of jobs, so their ids are counted before
    # they are sent to every task.
    linked = links.select(F.col("job_id").alias("id"))
    few = links.count() <= BROADCAST_LINKS
    touched = jobs.join(F.broadcast(linked) if few else linked, "id", "left_semi")
    tools = latest_tool_of_file(links, touched).withColumnRenamed("file_id", "id")
    owners = _of_page(users, "id", top, "user_id")
    rows = with_user_email(top, owners, "owner_email").join(tools, "id", "left")
    return rows.orderBy(*sort_columns(LISTINGS["files"], sort))


def list_jobs(jobs, users, job_files, files, q=None, sort=None, page=1, size=DEFAULT_SIZE, **v):
    """Jobs with user and file name, looked up for one page only."""
    top = cut_lineage(_top_first(jobs, "jobs", sort, page, size, q, **v))
    links = _of_page(job_files, "job_id", top, "id")
    naming = cut_lineage(naming_files(links))
    named = _of_page(files, "id", naming, "file_id")
    names = names_of(naming, named).withColumnRenamed("job_id", "id")
    rows = with_user_email(top, _of_page(users, "id", top, "user_id")).join(names, "id", "left")
    return rows.orderBy(*sort_columns(LISTINGS["jobs"], sort))


def list_feedback(feedback, q=None, page=1, size=DEFAULT_SIZE, **values):
    """Feedback newest first; attachments are reported, not read out."""
    rows = feedback.withColumn("has_attachment", has_attachment()).drop("attachment_data")
    return _top_first(rows, "feedback", None, page, size, q, **values)


def newest_of_owner(
    df: DataFrame, owner, limit: int = 50, offset: int = 0, status: str | None = None
) -> DataFrame:
    """O3: an owner's rows, newest first, at most 100 at a time.

    Jobs are listed in any state, files only while ``status`` is active.
    """
    if not 1 <= limit <= MAX_SIZE:
        raise ValueError("limit must lie within 1 and 100")
    mine = optional_equals(df.filter(F.col("user_id") == owner), status=status)
    return mine.orderBy(F.desc_nulls_first("created_at"), F.asc("id")).offset(offset).limit(limit)


def recent_activity(audit_logs: DataFrame, n: int) -> DataFrame:
    """Newest audit rows."""
    newest = audit_logs.orderBy(F.desc("created_at"), F.asc("id")).limit(n)
    return newest.select("id", "action", "summary", "actor_email", "category", "created_at")


def live_feed(jobs: DataFrame, users: DataFrame, now, n: int = 15) -> DataFrame:
    """Last jobs of the past fifteen minutes with the user's e-mail."""
    since = timestamp(now) - F.expr(f"INTERVAL {C.LIVE_WINDOW_MINUTES} MINUTES")
    order = (F.desc("created_at"), F.asc("id"))
    newest = cut_lineage(jobs.filter(F.col("created_at") >= since).orderBy(*order).limit(n))
    return with_user_email(newest, _of_page(users, "id", newest, "user_id")).orderBy(*order)
