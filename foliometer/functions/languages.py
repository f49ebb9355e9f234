"""Language codes, words and scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .text import col, let

WORD = r"[\p{L}\p{Nl}\p{No}]+"


def language_list_error(languages: Column | str) -> Column:
    """First failed rule of an ``a+b`` list: known codes, no repeats, at most four."""
    parts = F.split(col(languages), r"\+")
    known = F.array(*[F.lit(code) for code in C.LANGUAGES])
    return (
        F.when(F.size(F.array_except(parts, known)) > 0, "unsupported")
        .when(F.size(parts) != F.size(F.array_distinct(parts)), "duplicate")
        .when(F.size(parts) > C.MAX_LANGUAGES, "too_many")
    )


def words(text: Column | str) -> Column:
    """Runs of letters and letter-like numbers."""
    return F.regexp_extract_all(col(text), F.lit(f"({WORD})"), 1)


def _most_frequent_script(text: Column) -> Column:
    """Name of the script with the most characters, the first one in order on a tie."""

    def characters(name: str) -> Column:
        return F.length(text) - F.length(F.regexp_replace(text, rf"\p{{Is{name}}}+", ""))

    counted = F.array(
        *[
            F.struct(
                characters(name).alias("n"), F.lit(-order).alias("place"), F.lit(name).alias("name")
            )
            for order, name in enumerate(C.CHARACTER_SCRIPTS)
        ]
    )
    return let(F.array_max(counted), lambda best: F.when(best["n"] > 0, best["name"]))


def script(text: Column | str) -> Column:
    """L2: script with the most characters; NULL for text without any.

    Text within the Latin code blocks needs no counting.
    """
    text = col(text)
    latin = F.when(text.rlike(r"\p{IsLatin}"), "Latin")
    return F.when(text.rlike(r"[^\x00-\u024F]"), _most_frequent_script(text)).otherwise(latin)


def script_language(name: Column | str) -> Column:
    """L2: language pack of a script, NULL for Latin and unknown ones."""
    pairs = [F.lit(word) for pair in C.SCRIPT_LANGUAGES.items() for word in pair]
    return F.create_map(*pairs)[col(name)]


def stopword_table(spark: SparkSession) -> DataFrame:
    """(word, lang, ord): the fixed word lists as rows, about 150 of them."""
    rows = [
        (word, lang, order)
        for order, (lang, text) in enumerate(C.STOPWORDS.items())
        for word in text.split()
    ]
    return spark.createDataFrame(rows, "word string, lang string, ord int")
