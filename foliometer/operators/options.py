"""validation of tool options kept as string maps, all failed rules at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import blank, strip

# --- Fixed values: tools, option fields and their bounds --------------------------
CHOICES = {
    "split": {"mode": ("ranges", "every_page")},
    "rotate": {"angle": ("90", "180", "270"), "apply_to": ("all", "odd", "even")},
    "header-footer": {
        "font_family": ("helvetica", "times", "courier"),
        "align": ("left", "center", "right"),
        "header_align": ("left", "center", "right"),
        "footer_align": ("left", "center", "right"),
        "pages": ("all", "first", "last", "odd", "even", "custom"),
    },
    "page-numbers": {
        "position": (
            "bottom-center", "bottom-left", "bottom-right", "top-center", "top-left", "top-right",
        ),
    },
    "sign": {
        "position": ("bottom-right", "bottom-left", "bottom-center", "top-right", "top-left"),
    },
}
NUMBERS = {
    "header-footer": {"font_size": (6, 36), "opacity": (0.1, 1.0), "margin_mm": (5, 40)},
    "page-numbers": {"font_size": (6, 36), "margin_mm": (5, 40), "start_at": (1, None)},
    "sign": {"page": (1, None), "scale": (0.05, 0.8), "margin_mm": (0, 60)},
}
LENGTHS = {
    "metadata": {"title": 255, "author": 255, "subject": 255, "keywords": 255},
    "header-footer": {"header_text": 200, "footer_text": 200},
    "page-numbers": {"format": 100},
}
PATTERNS = {
    "rotate": {"pages": C.PAGE_SELECTION_PATTERN},
    "delete-pages": {"pages": C.PAGE_SELECTION_PATTERN},
    "extract-pages": {"pages": C.PAGE_SELECTION_PATTERN},
    "header-footer": {"color": C.COLOR_PATTERN, "page_range": C.PAGE_RANGE_PATTERN},
    "page-numbers": {"color": C.COLOR_PATTERN},
}
MAX_TERMS = 50
MAX_AREAS = 200


def _opt(name: str) -> Column:
    return F.col("options").getItem(name)


def _true(name: str) -> Column:
    return F.coalesce(F.lower(_opt(name)) == "true", F.lit(False))


def _json_items(name: str, element: str = "string") -> Column:
    return F.from_json(_opt(name), f"array<{element}>")


def _field_rules(tool: str):
    """(rule name, failed?) of the single-field rules of a tool."""
    for field, values in CHOICES.get(tool, {}).items():
        yield f"{field}_choice", ~_opt(field).isin(*values)
    for field, (low, high) in NUMBERS.get(tool, {}).items():
        number = _opt(field).try_cast("double")
        outside = (number < low) if high is None else ~number.between(low, high)
        yield f"{field}_range", _opt(field).isNotNull() & (number.isNull() | outside)
    for field, length in LENGTHS.get(tool, {}).items():
        yield f"{field}_length", F.length(_opt(field)) > length
    for field, pattern in PATTERNS.get(tool, {}).items():
        yield f"{field}_pattern", ~_opt(field).rlike(pattern)


def _joint_rules(tool: str):
    """(rule name, failed?) of required and mutually dependent fields."""
    if tool == "split":
        ranges = _json_items("ranges")
        by_range = F.coalesce(_opt("mode"), F.lit("ranges")) == "ranges"
        missing = F.coalesce(F.size(ranges), F.lit(0)) == 0
        malformed = ~F.forall(ranges, lambda spec: spec.rlike(C.PAGE_SELECTION_PATTERN))
        yield "ranges_required", by_range & (ranges.isNull() | missing)
        yield "ranges_pattern", by_range & malformed
    elif tool in ("delete-pages", "extract-pages"):
        yield "pages_required", _opt("pages").isNull()
    elif tool == "reorder":
        order = _json_items("order", "int")
        yield "order_required", order.isNull() | (F.size(order) < 1)
    elif tool == "metadata":
        fields = [blank(_opt(name)) for name in ("title", "author", "subject", "keywords")]
        nothing = fields[0] & fields[1] & fields[2] & fields[3]
        yield "field_required", ~_true("clear_existing") & nothing
    elif tool == "redact":
        terms = F.filter(_json_items("texts"), lambda term: strip(term) != "")
        areas = _json_items(
            "areas",
            "struct<page:int,x0:double,y0:double,x1:double,y1:double,mode:string,color:string,"
            "opacity:double>",
        )
        n_terms = F.when(terms.isNull(), 0).otherwise(F.size(terms))
        n_areas = F.when(areas.isNull(), 0).otherwise(F.size(areas))
        yield "target_required", (n_terms == 0) & (n_areas == 0)
        yield "texts_count", F.size(_json_items("texts")) > MAX_TERMS
        yield "areas_count", n_areas > MAX_AREAS
        yield "area_size", F.exists(
            areas, lambda a: (a["x1"] <= a["x0"]) | (a["y1"] <= a["y0"])
        )
        yield "area_range", F.exists(
            areas,
            lambda a: (a["page"] < 1) | (F.least(a["x0"], a["y0"], a["x1"], a["y1"]) < 0),
        )
        yield "area_missing", F.exists(
            areas,
            lambda a: a["page"].isNull()
            | a["x0"].isNull()
            | a["y0"].isNull()
            | a["x1"].isNull()
            | a["y1"].isNull(),
        )
        yield "area_mode", F.exists(areas, lambda a: ~a["mode"].isin(*C.AREA_MODES))
        yield "area_color", F.exists(areas, lambda a: ~a["color"].rlike(C.COLOR_PATTERN))
        yield "area_opacity", F.exists(areas, lambda a: ~a["opacity"].between(0.05, 1.0))
    elif tool == "header-footer":
        yield "text_required", blank(_opt("header_text")) & blank(_opt("footer_text"))
        yield "page_range_required", (_opt("pages") == "custom") & blank(_opt("page_range"))
    elif tool == "page-numbers":
        yield "format_page", ~F.contains(_opt("format"), F.lit("{page}"))
    elif tool == "fill-forms":
        yield "fields_required", F.coalesce(
            F.size(F.from_json(_opt("fields"), "map<string,string>")), F.lit(0)
        ) < 1


VALIDATED_TOOLS = (
    "split", "rotate", "delete-pages", "extract-pages", "reorder", "metadata", "redact",
    "header-footer", "page-numbers", "fill-forms", "sign",
)


def option_errors() -> Column:
    """Names of the rules a request (``tool``, ``options``) breaks, in rule order.

    A tool without option rules accepts anything.
    """
    failed = []
    for tool in VALIDATED_TOOLS:
        for name, broken in [*_field_rules(tool), *_joint_rules(tool)]:
            failed.append(F.when((F.col("tool") == tool) & broken, name))
    return F.array_compact(F.array(*failed))


def validate_options(requests: DataFrame) -> DataFrame:
    """Requests with ``errors`` and ``valid``."""
    checked = requests.withColumn("errors", option_errors())
    return checked.withColumn("valid", F.size("errors") == 0)
