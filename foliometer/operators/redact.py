"""Removal of terms and of page areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import strip
from ..functions.udfs import match_terms
from ..session import write_out
from .documents import document_lengths
from .skew import attach


# Failed documents that may be broadcast, so that cleaned pages need not move to meet them.
BROADCAST_FAILED = 100_000


def term_lists(terms: DataFrame) -> DataFrame:
    """Trimmed, de-duplicated terms per document in request order (``doc_id, terms``).

    The terms of a document come from one request, so they fit into one row.
    """
    cleaned = terms.withColumn("term", strip("term")).filter(F.col("term") != "")
    unique = cleaned.groupBy("doc_id", "term").agg(F.min("pos").alias("pos"))
    return unique.groupBy("doc_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda item: item["term"]
        ).alias("terms")
    )


def _matched(pages: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Pages with ``__match``, the hits per term and the cleaned text.

    A page carries the list of its document's terms; the text itself is never multiplied.
    One function counts and removes, so what is counted is what goes.
    """
    listed = lists.withColumnRenamed("terms", "__terms")
    planned = attach(pages, listed, ["doc_id"], ["page_no"], how=how)
    return planned.withColumn("__match", match_terms("text", "__terms")).drop("__terms")


def _hits(counts: DataFrame, lists: DataFrame) -> DataFrame:
    """Totals per term from pages' hits (``doc_id, hits array``), absent terms included."""
    found = (
        counts.select("doc_id", F.posexplode("hits").alias("at", "n"))
        .groupBy("doc_id", "at")
        .agg(F.sum("n").alias("hits"))
    )
    asked = lists.select("doc_id", F.posexplode("terms").alias("at", "term"))
    return asked.join(found, ["doc_id", "at"], "left").na.fill(0, ["hits"]).drop("at")


def _verdicts(hits: DataFrame) -> DataFrame:
    missing = F.array_sort(F.collect_set(F.when(F.col("hits") == 0, F.col("term"))))
    found = hits.groupBy("doc_id").agg(
        F.count("*").alias("n_terms"), F.sum("hits").alias("regions"), missing.alias("missing")
    )
    error = F.when(F.size("missing") == F.col("n_terms"), "none_found").when(
        F.size("missing") > 0, "terms_missing"
    )
    return found.withColumn("error", error)


def term_hits(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences of each term per document, counted on the original text."""
    lists = term_lists(terms)
    matched = _matched(pages.select("doc_id", "page_no", "text"), lists, "inner")
    return _hits(matched.select("doc_id", "__match.hits"), lists)


def redaction_verdicts(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """Whether each document can be redacted; one missing term fails it and is named."""
    return _verdicts(term_hits(pages, terms))


def redact(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """Pages without the terms of their document.

    Documents that fail (see ``redaction_verdicts``) yield no pages, so that nobody
    takes a half-cleaned document for a clean one; documents without a request keep
    their text. Page text is shuffled and matched once; hits and cleaned pages are stored,
    and the verdicts come from the stored hits.
    """
    lists = term_lists(terms)
    text = F.coalesce("__match.clean", "text").alias("text")
    others = [F.col(name) for name in pages.columns if name != "text"]
    matched = _matched(pages, lists, "left").select(*others, text, F.col("__match.hits").alias("__hits"))
    clean = write_out(matched, "redacted")
    counts = clean.filter("__hits IS NOT NULL").select("doc_id", F.col("__hits").alias("hits"))
    failed = _verdicts(_hits(counts, lists)).filter("error IS NOT NULL").select("doc_id")
    failed = write_out(failed, "redaction-failed")
    if failed.count() <= BROADCAST_FAILED:
        failed = F.broadcast(failed)
    return clean.join(failed, "doc_id", "left_anti").select(*pages.columns)


def check_areas(areas: DataFrame, pages: DataFrame) -> DataFrame:
    """Areas (``doc_id, position, page_no, x0, y0, x1, y1, mode, opacity``) with their error.

    Mode and opacity are brought to their defaults and bounds.
    """
    mode = F.lower(F.when(F.coalesce("mode", F.lit("")) != "", F.col("mode")).otherwise("black"))
    opacity = F.coalesce("opacity", F.lit(1.0))
    numbers = [F.col(name) for name in ("page_no", "x0", "y0", "x1", "y1")]
    malformed = F.array_contains(F.array(*[number.isNull() for number in numbers]), True)
    error = (
        F.when(malformed, "malformed")
        .when(~F.col("page_no").between(1, F.coalesce("n_pages", F.lit(0))), "page_out_of_range")
        .when((F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")), "degenerate")
        .when(~F.col("mode").isin(*C.AREA_MODES), "unknown_mode")
    )
    return (
        areas.join(document_lengths(pages), "doc_id", "left")
        .withColumn("mode", mode)
        .withColumn("opacity", F.greatest(F.lit(0.05), F.least(F.lit(1.0), opacity)))
        .withColumn("error", error)
        .drop("n_pages")
    )


def areas_per_page(checked: DataFrame) -> DataFrame:
    """Valid areas per page; a document with a faulty area has none."""
    faulty = checked.filter(F.col("error").isNotNull()).select("doc_id")
    return (
        checked.join(faulty, "doc_id", "left_anti")
        .groupBy("doc_id", "page_no")
        .agg(F.count("*").alias("areas"))
    )


def remove_in_areas(spans: DataFrame, checked: DataFrame) -> DataFrame:
    """Spans whose box touches no area of their page.

    ``spans`` carry ``x0, y0, x1, y1``. The equality part of the join is the page; a
    page has at most 200 areas. Documents with a faulty area are left out entirely.
    """
    faulty = checked.filter(F.col("error").isNotNull()).select("doc_id")
    areas = checked.filter(F.col("error").isNull()).select(
        "doc_id", "page_no", *[F.col(name).alias(f"a_{name}") for name in ("x0", "y0", "x1", "y1")]
    )
    s, a = spans.alias("s"), areas.alias("a")
    touches = (
        (F.col("s.doc_id") == F.col("a.doc_id"))
        & (F.col("s.page_no") == F.col("a.page_no"))
        & (F.col("s.x0") < F.col("a.a_x1"))
        & (F.col("a.a_x0") < F.col("s.x1"))
        & (F.col("s.y0") < F.col("a.a_y1"))
        & (F.col("a.a_y0") < F.col("s.y1"))
    )
    return s.join(a, touches, "left_anti").join(faulty, "doc_id", "left_anti")
