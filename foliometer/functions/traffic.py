"""Classification of visitors: user agent, country, traffic source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import blank, col, strip


def _first_match(text: Column, rules, default: str) -> Column:
    """Label of the first rule whose substrings occur in ``text``."""
    result = None
    for label, wanted, unwanted in rules:
        hit = F.lit(False)
        for word in wanted:
            hit = hit | F.contains(text, F.lit(word))
        for word in unwanted:
            hit = hit & ~F.contains(text, F.lit(word))
        result = F.when(hit, label) if result is None else result.when(hit, label)
    return result.otherwise(default)


def user_agent(agent: Column | str) -> Column:
    """struct(os, device, browser) of a User-Agent header."""
    text = F.lower(F.coalesce(col(agent), F.lit("")))
    return F.struct(
        _first_match(text, C.OS_RULES, "Other").alias("os"),
        _first_match(text, C.DEVICE_RULES, "Desktop").alias("device"),
        _first_match(text, C.BROWSER_RULES, "Other").alias("browser"),
    )


def country(accept_language: Column | str, cdn_country: Column | str) -> Column:
    """CDN header, else the region of the first language tag, else the default."""
    tag = strip(F.split(col(accept_language), ",")[0])
    region = F.upper(F.element_at(F.split(tag, "-"), -1))
    usable = F.contains(tag, F.lit("-")) & (F.length(region) == 2)
    return (
        F.when(~blank(cdn_country), F.upper(col(cdn_country)))
        .when(usable, region)
        .otherwise(C.DEFAULT_COUNTRY)
    )


def source(referrer: Column | str) -> Column:
    """Traffic source of a referrer; substring rules, first match wins."""
    referrer = col(referrer)
    return F.when(blank(referrer), C.DIRECT_SOURCE).otherwise(
        _first_match(F.lower(referrer), C.SOURCE_RULES, C.OTHER_SOURCE)
    )


def visit_source(explicit: Column | str, referrer: Column | str) -> Column:
    """Source of a visit: the one sent along wins over the referrer."""
    return F.when(~blank(explicit), col(explicit)).otherwise(source(referrer))
