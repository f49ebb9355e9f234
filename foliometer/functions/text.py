"""Small text helpers shared by the other expression modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: white space as Python's str.split sees it, as a character class. The
# characters below U+0100 are listed one by one, which the regex engine keeps as a bitmap.
SPACE = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it.

    Repeating a long expression inside itself would outgrow the generated code.
    """
    return F.transform(F.array(value), body)[0]


def strip(value: Column | str) -> Column:
    """Trim every kind of white space, not blanks alone."""
    return F.regexp_replace(col(value), f"^[{SPACE}]+|[{SPACE}]+$", "")


def blank(value: Column | str) -> Column:
    """NULL or empty."""
    value = col(value)
    return value.isNull() | (value == "")


def compact(value: Column | str) -> Column:
    """Comparison form without white space and letter case."""
    return F.lower(F.regexp_replace(col(value), f"[{SPACE}]+", ""))


def normal_email(value: Column | str) -> Column:
    """Trimmed, lower-cased e-mail address."""
    return F.lower(strip(value))


def slugify(value: Column | str, key: Column | str) -> Column:
    """E5: URL slug; an empty one is replaced by eight hex digits derived from ``key``."""
    dashed = F.regexp_replace(F.lower(strip(value)), r"[^a-z0-9]+", "-")
    slug = F.regexp_replace(dashed, r"^-+|-+$", "")
    return F.when(slug != "", slug).otherwise(
        F.substring(F.sha2(col(key).cast("string"), 256), 1, 8)
    )


def truncate(value: Column | str, length: int) -> Column:
    """First ``length`` characters."""
    return F.substring(col(value), 1, length)


def error_fingerprint(exc_type, file, function) -> Column:
    """Identity of an error by type and innermost frame.

    An error without a frame keeps the colon after its type.
    """
    frame = F.coalesce(F.concat_ws(":", col(file), col(function)), F.lit(""))
    has_frame = col(file).isNotNull()
    raw = F.concat(col(exc_type), F.lit(":"), F.when(has_frame, frame).otherwise(""))
    return F.substring(F.sha2(raw, 256), 1, 32)


def scrub_options(options: Column | str, keys) -> Column:
    """Replace the values of sensitive keys."""
    return F.transform_values(
        col(options), lambda key, value: F.when(key.isin(*keys), "[redacted]").otherwise(value)
    )


def client_ip(forwarded_for: Column | str, peer: Column | str) -> Column:
    """First hop of the forwarding header, else the peer address."""
    forwarded_for = col(forwarded_for)
    first = strip(F.split(forwarded_for, ",")[0])
    return F.when(~blank(forwarded_for), first).otherwise(col(peer))
