"""Repeated marks (watermarks) in text and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import compact
from .skew import attach

IMAGE_TRAITS = ("diagonal", "transparent", "centred", "big")


def _diagonal_angle(degrees: Column) -> Column:
    turned = F.pmod(degrees, F.lit(90.0))
    return (turned > C.DIAGONAL_TOLERANCE) & (turned < 90.0 - C.DIAGONAL_TOLERANCE)


def _covers_enough(pages: Column, total: Column) -> Column:
    """On at least two pages and at least half of a document of two pages or more."""
    return (total >= 2) & (pages >= F.greatest(F.lit(2), F.floor((total + 1) / 2)))


def _strongest(marks: DataFrame, key: str) -> DataFrame:
    """At most eight marks per document, most pages first."""
    order = W.partitionBy("doc_id").orderBy(F.desc("n_pages"), F.asc(key))
    return (
        marks.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= C.MARK_LIMIT)
        .drop("rank")
    )


def _traits(spans: DataFrame) -> DataFrame:
    """Spans with the two traits, and their normal form where they have one of them."""
    return (
        spans.withColumn("diagonal", _diagonal_angle(F.col("rotation_deg")))
        .withColumn("transparent", F.col("alpha") < C.OPAQUE)
        .withColumn(
            "norm", F.when(F.col("diagonal") | F.col("transparent"), compact("text"))
        )
    )


def _packed(traits: tuple[str, ...]) -> Column:
    """Boolean columns in one number, two bits each: true, known. An aggregate's buffer takes
    eight bytes for every column, so four maxima of booleans fill a third of it."""
    bits = F.lit(0)
    for at, name in enumerate(traits):
        true = F.when(F.col(name), 3 << 2 * at).when(~F.col(name), 2 << 2 * at).otherwise(0)
        bits = bits.bitwiseOR(true)
    return bits


def _unpacked(bits: str, traits: tuple[str, ...]) -> list[Column]:
    """What ``max`` of each trait gives, from ``bit_or`` of their packed form."""
    found = []
    for at, name in enumerate(traits):
        true, known = (F.col(bits).bitwiseAND(bit << 2 * at) != 0 for bit in (1, 2))
        found.append(F.when(known, true).alias(name))
    return found


def detect_marks(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """Text marks per document (``lengths(doc_id, n_pages)``).

    Candidates are reduced per page first and per document then, so a mark on every
    page of a long document is counted where it is read.
    """
    diagonal, transparent, size = F.col("diagonal"), F.col("transparent"), F.col("size_pt")
    strong = (
        (diagonal & transparent)
        | (diagonal & (size >= C.STRONG_DIAGONAL_SIZE))
        | (transparent & (size >= C.STRONG_ALPHA_SIZE))
    )
    candidates = (
        _traits(spans)
        .filter(diagonal | transparent)
        .filter(F.length("norm").between(C.MARK_TEXT_MIN, C.MARK_TEXT_MAX))
    )
    seen = (
        candidates.groupBy("doc_id", "norm", "page_no")
        .agg(F.count("*").alias("n"), F.max(strong).alias("strong"))
        .groupBy("doc_id", "norm")
        .agg(
            F.count("*").alias("n_pages"),
            F.max("n").alias("most_per_page"),
            F.max("strong").alias("strong"),
        )
    )
    totals = lengths.select("doc_id", F.col("n_pages").alias("total_pages"))
    is_mark = (
        F.col("strong")
        | (F.col("most_per_page") >= C.TILE_COUNT)
        | _covers_enough(F.col("n_pages"), F.col("total_pages"))
    )
    return _strongest(seen.join(totals, "doc_id", "inner").filter(is_mark), "norm")


def detect_image_marks(placements: DataFrame, lengths: DataFrame) -> DataFrame:
    """Image marks per document.

    ``placements`` hold a content digest, the placement matrix ``a..f``, transparency
    and the page box ``x0, y0, x1, y1``.
    """
    a, b, c, d, e, f = (F.col(name) for name in "abcdef")
    x0, y0, x1, y1 = (F.col(name) for name in ("x0", "y0", "x1", "y1"))
    ratio = F.abs(a * d - b * c) / F.greatest((x1 - x0) * (y1 - y0), F.lit(1.0))
    xs = [e, a + e, c + e, a + c + e]
    ys = [f, b + f, d + f, b + d + f]
    centre_x, centre_y = (x0 + x1) / 2, (y0 + y1) / 2
    flat = (F.abs(a) < 1e-9) & (F.abs(b) < 1e-9)
    seen = (
        placements.withColumn("ratio", ratio)
        .withColumn("diagonal", ~flat & _diagonal_angle(F.degrees(F.atan2(b, a))))
        .withColumn("transparent", (F.col("alpha") < C.OPAQUE) | F.col("has_smask"))
        .withColumn(
            "centred",
            centre_x.between(F.least(*xs), F.greatest(*xs))
            & centre_y.between(F.least(*ys), F.greatest(*ys))
            & (F.col("ratio") <= C.IMAGE_MAX_RATIO),
        )
        .withColumn("big", F.col("ratio").between(C.IMAGE_BIG_RATIO, C.IMAGE_MAX_RATIO))
        .withColumn("seen", _packed(IMAGE_TRAITS))
        .groupBy("doc_id", "digest", "page_no")
        .agg(F.count("*").alias("n"), F.bit_or("seen").alias("seen"))
        .groupBy("doc_id", "digest")
        .agg(
            F.count("*").alias("n_pages"),
            F.max("n").alias("most_per_page"),
            F.bit_or("seen").alias("seen"),
        )
        .select("doc_id", "digest", "n_pages", "most_per_page", *_unpacked("seen", IMAGE_TRAITS))
    )
    totals = lengths.select("doc_id", F.col("n_pages").alias("total_pages"))
    placed = F.col("centred") | F.col("big") | (F.col("most_per_page") >= C.TILE_COUNT)
    repeated = _covers_enough(F.col("n_pages"), F.col("total_pages"))
    is_mark = (
        F.col("diagonal")
        | (F.col("transparent") & placed)
        | (repeated & F.col("centred") & F.col("big"))
    )
    return _strongest(seen.join(totals, "doc_id", "inner").filter(is_mark), "digest")


def flag_marks(spans: DataFrame, marks: DataFrame, text: str | None = None) -> DataFrame:
    """Spans with ``removed``: a detected mark that carries a trait, or the user's text.

    The join key holds the text as well as the document; a mark that fills a long
    document is spread, and so are the spans without a trait, which match nothing.
    """
    known = marks.select("doc_id", "norm").distinct().withColumn("__mark", F.lit(True))
    flagged = attach(_traits(spans), known, ["doc_id", "norm"], ["page_no", "span_no"])
    removed = F.coalesce("__mark", F.lit(False))
    if text:
        needle = compact(F.lit(text))
        removed = removed | ((needle != "") & F.contains(compact("text"), needle))
    return flagged.withColumn("removed", removed).select(*spans.columns, "removed")


def remove_marks(spans: DataFrame, marks: DataFrame, text: str | None = None) -> DataFrame:
    """Spans without the marks."""
    return flag_marks(spans, marks, text).filter(~F.col("removed")).drop("removed")


def removal_counts(spans: DataFrame, marks: DataFrame, text: str | None = None) -> DataFrame:
    """Removed spans per document."""
    return (
        flag_marks(spans, marks, text)
        .groupBy("doc_id")
        .agg(F.count_if("removed").alias("removed"))
    )
