"""Page selections and page templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .filters import timestamp
from .text import blank, col, let, strip

def _bounds(part: Column) -> Column:
    """First and last page of ``7`` or ``3-5``."""
    ends = F.split(part, "-", 2)
    return F.struct(
        ends[0].try_cast("bigint").alias("first"),
        F.element_at(ends, -1).try_cast("bigint").alias("last"),
    )


def selection_ranges(spec: Column | str) -> Column:
    """Ranges of a selection such as ``1,3-5`` in the order written, NULL when malformed."""
    parts = F.filter(F.split(F.replace(col(spec), F.lit(" ")), ","), lambda part: part != "")
    well_formed = F.forall(parts, lambda part: part.rlike(r"^\d{1,18}(-\d{1,18})?$"))
    return F.when(well_formed, F.transform(parts, _bounds))


def _forward(ranges: Column) -> Column:
    return F.filter(ranges, lambda r: r["first"] <= r["last"])


def _range_error(ranges: Column, total: Column) -> Column:
    beyond = F.exists(ranges, lambda r: (r["first"] < 1) | (r["last"] > total))
    return (
        F.when(ranges.isNull(), "invalid")
        .when(F.size(ranges) == 0, "empty")
        .when(beyond, "out_of_range")
    )


def selection_error(spec: Column | str, total: Column | str) -> Column:
    """``invalid``, ``empty`` or ``out_of_range``; NULL for a usable selection.

    Decided from the bounds alone: no page list is built for a hostile range.
    """
    total = col(total)
    return let(_forward(selection_ranges(spec)), lambda ranges: _range_error(ranges, total))


def select_pages(spec: Column | str, total: Column | str) -> Column:
    """Ordered page numbers with repeats; NULL where the selection has an error.

    ``sequence`` counts down for a reversed range, which here selects nothing.
    """
    total = col(total)

    def listed(ranges: Column) -> Column:
        pages = F.flatten(F.transform(ranges, lambda r: F.sequence(r["first"], r["last"])))
        return F.when(_range_error(ranges, total).isNull(), pages.cast("array<int>"))

    return let(_forward(selection_ranges(spec)), listed)


def out_of_range_pages(spec: Column | str, total: Column | str) -> Column:
    """The sorted distinct pages named by an ``out_of_range`` error."""
    ranges, total = _forward(selection_ranges(spec)), col(total)
    low = F.flatten(
        F.transform(
            F.filter(ranges, lambda r: r["first"] < 1),
            lambda r: F.sequence(r["first"], F.least(r["last"], F.lit(0))),
        )
    )
    high = F.flatten(
        F.transform(
            F.filter(ranges, lambda r: r["last"] > total),
            lambda r: F.sequence(F.greatest(r["first"], total + 1), r["last"]),
        )
    )
    return F.array_sort(F.array_distinct(F.concat(low, high)))


def page_matches(mode, page_range, page: Column | str, total: Column | str) -> Column:
    """Whether a page is meant by all/first/last/odd/even/custom.

    A range given together with ``all`` is honoured; an empty range means every page.
    """
    mode = mode if isinstance(mode, Column) else F.lit(mode)
    ranged = page_range if isinstance(page_range, Column) else F.lit(page_range).cast("string")
    page, total = col(page), col(total)
    parts = F.transform(F.split(ranged, ","), lambda part: _bounds(strip(part)))
    within = F.exists(parts, lambda r: (r["first"] <= page) & (page <= r["last"]))
    return (
        F.when(mode.isin("custom", "all"), blank(ranged) | within)
        .when(mode == "first", page == 1)
        .when(mode == "last", page == total)
        .when(mode == "odd", page % 2 == 1)
        .when(mode == "even", page % 2 == 0)
        .otherwise(F.lit(True))
    )


def fill_template(template, page: Column, total: Column, now, filename=None) -> Column:
    """Page placeholders, replaced one after the other."""
    text = template if isinstance(template, Column) else F.lit(template)
    moment = timestamp(now)
    values = (
        ("{page}", page.cast("string")),
        ("{total}", total.cast("string")),
        ("{date}", F.date_format(moment, "yyyy-MM-dd")),
        ("{time}", F.date_format(moment, "HH:mm")),
        ("{filename}", F.lit("") if filename is None else filename),
    )
    for mark, value in values:
        text = F.replace(text, F.lit(mark), value)
    return text
