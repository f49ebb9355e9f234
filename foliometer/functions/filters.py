"""Filters and predicates with the semantics of the admin panel's query parameters."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .text import col


def timestamp(value) -> Column:
    """Literal or column as a timestamp; strings and datetimes are read as UTC."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.replace(tzinfo=None).isoformat(sep=" ")
    elif isinstance(value, date):
        value = value.isoformat()
    return F.lit(value).cast("timestamp")


def optional_equals(df: DataFrame, **values) -> DataFrame:
    """equality per column; an absent or empty value filters nothing."""
    for name, value in values.items():
        if value:
            df = df.filter(F.col(name) == value)
    return df


def optional_equals_ignore_case(df: DataFrame, **values) -> DataFrame:
    """case-insensitive equality per column; an empty value filters nothing."""
    for name, value in values.items():
        if value:
            df = df.filter(F.lower(name) == value.lower())
    return df


def _like_pattern(query: str) -> str:
    """``%query%`` with backslashes that escape nothing removed.

    Wildcards in the query stay wildcards. Spark rejects an escape before any
    other character, where the SQL standard's users expect the character itself.
    """
    text, pattern, position = f"%{query.lower()}%", [], 0
    while position < len(text):
        letter = text[position]
        if letter == "\\" and position + 1 < len(text):
            position += 1
            follower = text[position]
            pattern.append(f"\\{follower}" if follower in "%_\\" else follower)
        else:
            pattern.append(letter)
        position += 1
    return "".join(pattern)


def search(df: DataFrame, columns, query: str | None) -> DataFrame:
    """substring search over any of ``columns``; ``%`` and ``_`` act as wildcards."""
    if not query:
        return df
    pattern = _like_pattern(query)
    return df.filter(reduce(or_, [F.lower(name).like(pattern) for name in columns]))


def _parse_day(text: str | None, default: date) -> date:
    try:
        return datetime.strptime(text, "%Y-%m-%d").date() if text else default
    except ValueError:
        return default


def date_bounds(start: str | None, end: str | None, now) -> tuple[date, date]:
    """first and last day; defaults are today and thirty days before the last day."""
    today = datetime.fromisoformat(str(now)).date()
    last = _parse_day(end, today)
    return _parse_day(start, last - timedelta(days=30)), last


def between_days(ts: Column | str, first: date, last: date) -> Column:
    """Half-open form of an inclusive day range, so that Parquet statistics apply."""
    return (col(ts) >= timestamp(first)) & (col(ts) < timestamp(last + timedelta(days=1)))


def in_date_range(df: DataFrame, ts: str, start, end, now) -> DataFrame:
    """F4 as a filter."""
    return df.filter(between_days(ts, *date_bounds(start, end, now)))


def visitor_type(df: DataFrame, kind: str | None) -> DataFrame:
    """``unique`` or ``returning``; any other value filters nothing."""
    if kind == "unique":
        return df.filter(~F.col("is_returning"))
    if kind == "returning":
        return df.filter(F.col("is_returning"))
    return df


def one_of(df: DataFrame, column: str, values) -> DataFrame:
    """membership in a list given by the caller."""
    return df.filter(F.col(column).isin(*values))


def expired_file(now, expires="expires_at") -> Column:
    """active and past its expiry."""
    return (F.col("status") == "active") & (F.col(expires) < timestamp(now))


def expired_job(now, expires="expires_at") -> Column:
    """F8: finished, not yet expired, and past its expiry."""
    return F.col("status").isin(*C.EXPIRABLE_STATUSES) & (F.col(expires) < timestamp(now))


def owned_by(owner, column: Column | str = "user_id") -> Column:
    """null-safe ownership; NULL is the anonymous owner."""
    owner = owner if isinstance(owner, Column) else F.lit(owner)
    return col(column).eqNullSafe(owner)


def downloadable(now, owner, expires="expires_at", user="user_id") -> Column:
    """active, owned, not past expiry (expiring right now still counts)."""
    alive = F.coalesce(F.col(expires) >= timestamp(now), F.lit(True))
    return (F.col("status") == "active") & owned_by(owner, user) & alive


def paying(df: DataFrame) -> DataFrame:
    """any plan but the free one; a NULL plan does not pass."""
    return df.filter(F.col("plan") != C.DEFAULT_PLAN)


def unread_only(df: DataFrame, unread: bool | None) -> DataFrame:
    """unread rows when asked for; ``False`` filters nothing."""
    return df.filter(~F.col("is_read")) if unread else df


def has_attachment(data: Column | str = "attachment_data") -> Column:
    """F13."""
    return col(data).isNotNull()


def dimension_filters(df: DataFrame, params: dict | None) -> DataFrame:
    """The device, browser, country, source and visitor filters of both dashboards."""
    params = params or {}
    names = ("device", "browser", "country", "source")
    chosen = {name: params[name] for name in names if params.get(name)}
    return visitor_type(optional_equals_ignore_case(df, **chosen), params.get("visitor_type"))


def dashboard_filters(df: DataFrame, params: dict | None, now) -> DataFrame:
    """All filters of the dashboards: date range, dimensions, visitor type."""
    params = params or {}
    ranged = in_date_range(df, "created_at", params.get("start"), params.get("end"), now)
    return dimension_filters(ranged, params)
