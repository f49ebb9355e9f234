"""Page-by-page comparison of document pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import UNCHANGED_RATIO
from ..functions.udfs import diff_lines, differs, similarity


def paired_pages(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pages of both documents side by side; a missing page is an empty text.

    ``pairs(pair_id, doc_a, doc_b)``. The join key includes the page number, so a long
    document is spread over tasks.
    """

    def side(name: str) -> DataFrame:
        ids = pairs.select("pair_id", F.col(f"doc_{name}").alias("doc_id"))
        joined = pages.select("doc_id", "page_no", "text").join(ids, "doc_id", "inner")
        return joined.select("pair_id", "page_no", F.col("text").alias(f"text_{name}"))

    both = side("a").join(side("b"), ["pair_id", "page_no"], "full")
    return both.na.fill("", ["text_a", "text_b"])


def compare_pages(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Similarity and first changed lines of every page.

    Equal pages never leave the JVM; only the others are sent to Python.
    """
    both = paired_pages(pages, pairs)
    unequal = F.when(F.col("text_a") != F.col("text_b"), F.col("text_a"))
    rated = both.withColumn(
        "ratio", F.coalesce(similarity(unequal, F.col("text_b")), F.lit(1.0))
    ).withColumn("changed", F.col("ratio") < UNCHANGED_RATIO)
    shown = F.when(F.col("changed"), F.col("text_a"))
    return rated.withColumn("lines", diff_lines(shown, F.col("text_b"))).select(
        "pair_id", "page_no", "ratio", "changed", "lines"
    )


def settled_changes(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both texts of each page and ``settled``: whether it changed, where lengths tell.

    Equal texts have not changed. Twice the shorter length over the common length bounds the
    similarity from above; it is 0 for a page that one document lacks. Where neither decides,
    ``settled`` is NULL.
    """
    both = paired_pages(pages, pairs)
    size_a, size_b = F.length("text_a"), F.length("text_b")
    bound = 2.0 * F.least(size_a, size_b) / (size_a + size_b)
    settled = F.when(F.col("text_a") == F.col("text_b"), F.lit(False)).when(
        bound < UNCHANGED_RATIO, F.lit(True)
    )
    return both.withColumn("settled", settled)


def page_changes(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether each page changed, without its exact similarity.

    Most pages are settled in the JVM. For the rest the characters they share and the
    blocks found so far bound the similarity, until a bound decides.
    """
    known = settled_changes(pages, pairs)
    # Settled pages are sent as NULL; the long texts stay behind.
    open_a = F.when(F.col("settled").isNull(), F.col("text_a"))
    open_b = F.when(F.col("settled").isNull(), F.col("text_b"))
    return known.withColumn("changed", F.coalesce("settled", differs(open_a, open_b))).select(
        "pair_id", "page_no", "changed"
    )


def compare_documents(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Changed pages and pages in total per pair."""
    return (
        page_changes(pages, pairs)
        .groupBy("pair_id")
        .agg(
            F.count_if("changed").alias("changed_pages"),
            F.max("page_no").cast("long").alias("total_pages"),
        )
    )
