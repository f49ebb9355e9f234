"""Page operations over a table with one row per page.

A document may be very long, so no operator builds an array of its pages. Page
selections are kept as ranges; positions in a result come from arithmetic on the
ranges instead of a window over the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.filenames import file_stem
from ..functions.pages import fill_template, page_matches, selection_error, selection_ranges
from ..functions.text import blank
from .prefix import running_total
from .skew import attach

# Pages that are joined to ranges together.
BLOCK = 256
# A selection of pages: its document and a digest of its text, which is too long to go with
# every range.
SELECTION = ["doc_id", "selection"]


def document_lengths(pages: DataFrame) -> DataFrame:
    """Number of pages per document."""
    return pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_pages"))


def _to_pages(pages: DataFrame, per_document: DataFrame, how: str = "left") -> DataFrame:
    """Pages joined to one row per document, long documents spread over tasks."""
    counts = document_lengths(pages).withColumnRenamed("n_pages", "rows")
    return attach(pages, per_document, ["doc_id"], ["page_no"], counts, how)


def page_counts(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Page count per known document; one without pages is an error."""
    counted = documents.select("doc_id").join(document_lengths(pages), "doc_id", "left")
    return counted.na.fill(0, ["n_pages"]).withColumn(
        "error", F.when(F.col("n_pages") == 0, "no_pages")
    )


def merge_documents(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents concatenated by a plan (``out_doc, input_pos, doc_id``).

    The start of each input is a running total over the plan's rows; a page then
    adds its own number. An input may occur several times.
    """
    placed = plan.join(document_lengths(pages), "doc_id", "inner")
    ends = running_total(
        placed, ["out_doc"], ["input_pos", "doc_id"], F.col("n_pages").cast("long"), "end"
    )
    offsets = ends.select(
        "out_doc", "input_pos", "doc_id", (F.col("end") - F.col("n_pages")).alias("offset")
    )
    return pages.join(offsets, "doc_id", "inner").select(
        "out_doc",
        "input_pos",
        "doc_id",
        "page_no",
        (F.col("offset") + F.col("page_no")).alias("out_page"),
        "text",
    )


def _ranges(selections: DataFrame, column: str, keys) -> DataFrame:
    """One row per range of a selection (``keys, at, first, last``), as written."""
    ranges = F.posexplode(selection_ranges(column)).alias("at", "r")
    rows = selections.select(*keys, ranges).select(*keys, "at", "r.first", "r.last")
    return rows.filter("first <= last")


def _placed_ranges(selections: DataFrame, column: str, keys) -> DataFrame:
    """Ranges ``r`` with ``skip``: how many pages the ranges before them select.

    The rows of a group come from the text of one selection.
    """
    rows = _ranges(selections, column, keys)
    earlier = W.partitionBy(*keys).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    skip = F.coalesce(F.sum(F.col("last") - F.col("first") + 1).over(earlier), F.lit(0))
    return rows.select(*keys, F.struct("first", "last", skip.alias("skip")).alias("r"))


def _disjoint_ranges(rows: DataFrame, keys) -> DataFrame:
    """Ranges that cover the same pages once: each starts behind all that start before it."""
    order = W.partitionBy(*keys).orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    start = F.greatest("first", F.coalesce(reached, F.lit(-1)) + 1)
    return rows.withColumn("start", start).filter("start <= last").drop("first").withColumnRenamed("start", "first")


def _pages_in(pages: DataFrame, ranges: DataFrame, how: str = "inner") -> DataFrame:
    """Pages joined to the ranges (``r``) of their document that contain them.

    Pages meet ranges block by block: a long document is spread over tasks, and a page
    is only compared with the ranges that touch its block.
    """

    def block(page: Column) -> Column:
        return F.floor((page - 1) / BLOCK)

    touched = F.explode(F.sequence(block(F.col("r.first")), block(F.col("r.last"))))
    blocks = ranges.withColumn("block", touched)
    keyed = pages.withColumn("block", block(F.col("page_no")))
    p, b = keyed.alias("p"), blocks.alias("b")
    within = (
        (F.col("p.doc_id") == F.col("b.doc_id"))
        & (F.col("p.block") == F.col("b.block"))
        & F.col("p.page_no").between(F.col("b.r.first"), F.col("b.r.last"))
    )
    own = [F.col(f"p.{name}") for name in pages.columns]
    others = [F.col(f"b.{name}") for name in ranges.columns if name != "doc_id"]
    return p.join(b, within, how).select(*own, *others)


def _checked(specs: DataFrame, pages: DataFrame, selection: str = "pages") -> DataFrame:
    """Selections with the document's length and the selection's error."""
    lengths = document_lengths(pages)
    known = specs.join(lengths, "doc_id", "left")
    error = F.when(F.col("n_pages").isNull(), "no_pages").otherwise(
        selection_error(selection, "n_pages")
    )
    return known.withColumns({"error": error, "selection": F.md5(selection)})


def selection_errors(specs: DataFrame, pages: DataFrame, deleting: bool = False) -> DataFrame:
    """Selections that fail, with their error; for a deletion also those that take all pages."""
    checked = _checked(specs, pages)
    if deleting:
        usable = checked.filter(F.col("error").isNull())
        single = _disjoint_ranges(_ranges(usable, "pages", SELECTION), SELECTION)
        covered = single.groupBy(*SELECTION).agg(
            F.sum(F.col("last") - F.col("first") + 1).alias("covered")
        )
        everything = F.when(F.col("covered") >= F.col("n_pages"), "all_pages")
        checked = checked.join(covered, SELECTION, "left").withColumn(
            "error", F.coalesce("error", everything)
        )
    return checked.filter(F.col("error").isNotNull()).select("doc_id", "pages", "error")


def extract_pages(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """Selected pages in the order given, repeats kept (``specs(doc_id, pages)``)."""
    usable = _checked(specs, pages).filter(F.col("error").isNull())
    ranges = _placed_ranges(usable, "pages", SELECTION).drop("selection")
    return _pages_in(pages, ranges).select(
        "doc_id",
        (F.col("r.skip") + F.col("page_no") - F.col("r.first") + 1).alias("out_page"),
        "page_no",
        "text",
    )


def split_documents(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """D3: one part per range entry, or per page (``specs(doc_id, name, ranges, every_page)``).

    A faulty entry fails its whole document. The label of a part is its entry with
    commas replaced, the output name carries the document's stem.
    """
    lengths = document_lengths(pages)
    sized = specs.join(lengths, "doc_id", "inner")
    faulty = F.exists("ranges", lambda spec: selection_error(spec, "n_pages").isNotNull())
    by_range = sized.filter(~F.col("every_page") & ~faulty).select(
        "doc_id", "name", F.posexplode("ranges").alias("part", "label")
    )
    numbered = by_range.withColumn("part", (F.col("part") + 1).cast("long"))
    pieces = _placed_ranges(numbered, "label", ["doc_id", "name", "part", "label"])
    ranged = _pages_in(pages, pieces).select(
        "doc_id",
        "name",
        "part",
        "label",
        (F.col("r.skip") + F.col("page_no") - F.col("r.first") + 1).alias("out_page"),
        "page_no",
        "text",
    )
    singly = pages.join(
        specs.filter("every_page").select("doc_id", "name"), "doc_id", "inner"
    ).select(
        "doc_id",
        "name",
        F.col("page_no").cast("long").alias("part"),
        F.col("page_no").cast("string").alias("label"),
        F.lit(1).cast("long").alias("out_page"),
        "page_no",
        "text",
    )
    label = F.replace("label", F.lit(","), F.lit("_"))
    output = F.concat(file_stem("name"), F.lit("-pages-"), label, F.lit(".pdf"))
    return (
        ranged.unionByName(singly)
        .withColumn("label", label)
        .withColumn("output_name", output)
        .drop("name")
    )


def delete_pages(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """Documents without the selected pages, renumbered.

    Failed selections, among them those that would leave no page, yield no rows; see
    ``selection_errors``.
    """
    usable = _checked(specs, pages).filter(F.col("error").isNull())
    # A page 0 in front of every document lets each gap follow a deleted range.
    keys = [*SELECTION, "n_pages"]
    front = usable.select(*keys, F.lit(-1).alias("at"), *[F.lit(0).cast("long").alias(n) for n in ("first", "last")])
    gone = _disjoint_ranges(_ranges(usable, "pages", keys).unionByName(front), keys)
    order = W.partitionBy(*keys).orderBy("first", "last")
    next_gone = F.coalesce(F.lead("first").over(order), F.col("n_pages") + 1)
    removed = F.sum(F.col("last") - F.col("first") + 1).over(
        order.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    left = gone.select(
        "doc_id",
        F.struct(
            (F.col("last") + 1).alias("first"),
            (next_gone - 1).alias("last"),
            (removed - 1).alias("removed"),
        ).alias("r"),
    ).filter("r.first <= r.last")
    return _pages_in(pages, left).select(
        "doc_id", (F.col("page_no") - F.col("r.removed")).alias("out_page"), "page_no", "text"
    )


def _order_verdicts(pages: DataFrame, orders: DataFrame) -> DataFrame:
    """Whether the rows of an order are a permutation of the document's pages."""
    shape = orders.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.countDistinct("page_no").alias("different"),
        F.min("page_no").alias("low"),
        F.max("page_no").alias("high"),
    )
    total = F.col("n_pages")
    whole = (
        (F.col("n") == total)
        & (F.col("different") == total)
        & (F.col("low") == 1)
        & (F.col("high") == total)
    )
    verdict = F.coalesce(whole, F.lit(False))
    return shape.join(document_lengths(pages), "doc_id", "left").select(
        "doc_id", verdict.alias("valid")
    )


def order_errors(pages: DataFrame, orders: DataFrame) -> DataFrame:
    """Documents whose order is no permutation of 1..N."""
    return _order_verdicts(pages, orders).filter(~F.col("valid")).select("doc_id")


def reorder_pages(pages: DataFrame, orders: DataFrame) -> DataFrame:
    """Pages rearranged by ``orders(doc_id, out_page, page_no)``, one row per page."""
    valid = _order_verdicts(pages, orders).filter("valid").select("doc_id")
    usable = orders.join(valid, "doc_id", "left_semi")
    return pages.join(usable, ["doc_id", "page_no"], "inner").select(
        "doc_id", "out_page", "page_no", "text"
    )


def rotate_pages(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """Turn selected pages further (``specs(doc_id, angle, pages, apply_to)``).

    No selection means every page; ``apply_to`` keeps odd or even ones. Documents
    without a usable specification stay as they are, with the ``error``.
    """
    lengths = document_lengths(pages)
    angle_error = F.when(
        (F.col("angle") % 90 != 0) | (F.col("angle") % 360 == 0), "invalid_angle"
    )
    page_error = F.when(~blank("pages"), selection_error("pages", "n_pages"))
    keys = ["doc_id", "angle", "apply_to", "error", "n_pages"]
    checked = specs.join(lengths, "doc_id", "inner").withColumn(
        "error", F.coalesce(angle_error, page_error)
    )
    # A document with an error carries it on all its pages.
    whole = blank("pages") | F.col("error").isNotNull()
    first, last = F.lit(1).cast("long").alias("first"), F.col("n_pages").cast("long").alias("last")
    all_pages = checked.filter(whole).select(*keys, first, last)
    some_pages = _disjoint_ranges(_ranges(checked.filter(~whole), "pages", keys), keys).drop("at")
    ranges = all_pages.unionByName(some_pages).select(
        "doc_id", "angle", "apply_to", "error", F.struct("first", "last").alias("r")
    )
    page = F.col("page_no")
    parity = (
        F.when(F.col("apply_to") == "odd", page % 2 == 1)
        .when(F.col("apply_to") == "even", page % 2 == 0)
        .otherwise(F.lit(True))
    )
    turned = F.col("r").isNotNull() & F.col("error").isNull() & parity
    rotation = F.when(turned, F.pmod(F.col("rotation") + F.col("angle"), F.lit(360)))
    return (
        _pages_in(pages, ranges, "left")
        .withColumn("rotation", F.coalesce(rotation, "rotation"))
        .drop("angle", "apply_to", "r")
    )


def stamp_pages(pages: DataFrame, specs: DataFrame, now) -> DataFrame:
    """Header and footer lines of the pages a specification selects.

    ``specs(doc_id, filename, header_text, footer_text, pages, page_range)``.
    """
    chosen = page_matches(F.col("pages"), F.col("page_range"), "page_no", "total_pages")

    def line(template: str) -> Column:
        text = fill_template(
            F.col(template), F.col("page_no"), F.col("total_pages"), now, F.col("filename")
        )
        return F.when(chosen & ~blank(template), text)

    return (
        _to_pages(pages, specs)
        .withColumn("header", line("header_text"))
        .withColumn("footer", line("footer_text"))
        .drop("filename", "header_text", "footer_text", "pages", "page_range")
    )


def number_pages(pages: DataFrame, specs: DataFrame, now) -> DataFrame:
    """Page number lines; the start value shifts number and total alike.

    ``specs(doc_id, format, start_at, skip_first)``. The file name is not available
    to page numbers and leaves its placeholder empty.
    """
    shift = F.col("start_at") - 1
    text = fill_template(
        F.col("format"), F.col("page_no") + shift, F.col("total_pages") + shift, now
    )
    skipped = F.col("skip_first") & (F.col("page_no") == 1)
    return (
        _to_pages(pages, specs)
        .withColumn("page_label", F.when(~skipped, text))
        .drop("format", "start_at", "skip_first")
    )


METADATA_FIELDS = ("title", "author", "subject", "keywords")


def set_metadata(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Document information after changes (``doc_id, fields, clear_existing``).

    ``metadata`` and ``fields`` are string maps; unknown fields are ignored.
    """
    known = F.map_filter(
        F.coalesce("fields", F.create_map().cast("map<string,string>")),
        lambda key, value: key.isin(*METADATA_FIELDS) & value.isNotNull(),
    )
    dropped = F.coalesce("clear_existing", F.lit(False))
    kept = F.map_filter(
        "metadata", lambda key, value: ~dropped & ~F.map_contains_key(F.col("known"), key)
    )
    return (
        documents.join(changes, "doc_id", "left")
        .withColumn("known", known)
        .withColumn("metadata", F.map_concat(kept, F.col("known")))
        .drop("known", "fields", "clear_existing")
    )
