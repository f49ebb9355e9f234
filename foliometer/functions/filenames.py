"""Client-supplied file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import blank, col, let
from .udfs import nfkc


def posix_name(path: Column | str) -> Column:
    """Last component of a slash-separated path."""
    trimmed = F.regexp_replace(col(path), r"(/+\.?)+$", "")
    return F.regexp_replace(F.regexp_extract(trimmed, r"([^/]*)$", 1), r"^\.$", "")


def windows_name(path: Column | str) -> Column:
    """Last component of a backslash-separated path, drive or share removed."""
    bare = F.regexp_replace(col(path), r"^(\\\\[^\\]+\\[^\\]+|[^\\]:)", "")
    trimmed = F.regexp_replace(bare, r"(\\+\.?)+$", "")
    return F.regexp_replace(F.regexp_extract(trimmed, r"([^\\]*)$", 1), r"^\.$", "")


def base_name(path: Column | str) -> Column:
    return windows_name(posix_name(path))


def file_extension(path: Column | str) -> Column:
    """Lower-case last suffix without its dot; none for a leading-dot name."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+\.([^.]+)$", 1))


def file_stem(path: Column | str) -> Column:
    """File name without directories and last suffix."""
    return F.regexp_replace(posix_name(path), r"(?s)^(.+)\.[^.]+$", "$1")


def sanitize_filename(path: Column | str, fallback: str = "file") -> Column:
    """Display-safe file name of at most 200 characters, extension kept."""
    base = base_name(path)
    # Only names with a non-ASCII character travel to the Python worker.
    composed = F.coalesce(nfkc(F.when(base.rlike(r"[^\x00-\x7F]"), base)), base)
    safe = F.regexp_replace(composed, r'[<>:"/\\|?*\x00-\x1f]', "_")
    name = F.regexp_replace(safe, r"^[ .]+|[ .]+$", "")
    return F.when(blank(path), fallback).otherwise(let(name, lambda n: _shortened(n, fallback)))


def _shortened(name: Column, fallback: str) -> Column:
    """Reserved stems marked, stem cut to leave room for the extension."""
    suffix = F.regexp_extract(name, r"(?s)\.([^.]+)$", 1)
    tail = F.when(suffix == "", "").otherwise(F.concat(F.lit("."), suffix))
    stem = F.regexp_replace(name, r"(?s)\.[^.]+$", "")
    mark = F.when(F.upper(stem).isin(*C.RESERVED_NAMES), "_").otherwise("")
    # An oversized suffix eats into the stem from its end.
    room = F.lit(C.FILENAME_LENGTH) - F.length(tail)
    kept = F.when(room >= 0, room).otherwise(F.greatest(F.lit(0), F.length(stem) + room))
    short = F.substring(F.concat(stem, mark), F.lit(1), kept)
    return F.when(name == "", fallback).otherwise(
        F.concat(F.coalesce(F.nullif(short, F.lit("")), F.lit(fallback)), tail)
    )


def sharded_path(created_at: Column | str, stored_name: Column | str) -> Column:
    """``YYYY/MM/DD/name`` location of a stored file."""
    return F.concat_ws("/", F.date_format(col(created_at), "yyyy/MM/dd"), col(stored_name))


def stored_name(key: Column | str, extension: Column | str) -> Column:
    """Name on disk, 32 hex digits derived from the row key."""
    digits = F.substring(F.sha2(col(key).cast("string"), 256), 1, 32)
    ext = F.lower(F.regexp_replace(col(extension), r"^\.+", ""))
    return F.when(blank(ext), digits).otherwise(F.concat(digits, F.lit("."), ext))
