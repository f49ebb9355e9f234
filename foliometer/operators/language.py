"""L1-L3: language of pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.languages import script, script_language, stopword_table, words
from ..functions.text import let


def guess_language(texts: DataFrame, keys=("doc_id",)) -> DataFrame:
    """L1: language of Latin-script texts by frequent words; NULL when in doubt.

    Every text row is one row of ``keys``. Words meet the fixed word list (about 180
    rows) in a broadcast join and are summed per text before the shuffle, so only ten
    counters per text move.
    """
    keys = list(keys)
    spark = texts.sparkSession
    split = texts.select(*keys, words("text").alias("words"))
    exploded = split.select(
        *keys, F.size("words").alias("n_words"), F.explode_outer("words").alias("word")
    ).withColumn("word", F.lower("word"))
    hit = exploded.join(F.broadcast(stopword_table(spark)), "word", "left")
    counters = [F.count_if(F.col("lang") == lang).alias(lang) for lang in C.STOPWORDS]
    counted = hit.groupBy(*keys).agg(F.max("n_words").alias("n_words"), *counters)
    ranked = F.array(
        *[
            F.struct(
                F.col(lang).alias("hits"), F.lit(-order).alias("place"), F.lit(lang).alias("lang")
            )
            for order, lang in enumerate(C.STOPWORDS)
        ]
    )
    best = F.array_max(ranked)
    ahead = (best["lang"] == "eng") | (best["hits"] >= C.ENGLISH_MARGIN * F.col("eng"))
    sure = (F.col("n_words") >= C.MIN_WORDS) & (best["hits"] >= C.MIN_STOPWORD_HITS) & ahead
    return counted.select(
        *keys,
        F.greatest("n_words", F.lit(0)).cast("long").alias("n_words"),
        best["hits"].alias("hits"),
        F.when(sure, best["lang"]).alias("language"),
    )


def page_scripts(pages: DataFrame) -> DataFrame:
    """L2: script of each page and its language pack."""
    named = pages.select("doc_id", "page_no", script("text").alias("script"))
    return named.withColumn("language", script_language("script"))


def document_language(
    pages: DataFrame, fallback: str = "eng", sample_pages: int = C.SAMPLE_PAGES
) -> DataFrame:
    """L3: language of each document from its first pages.

    The most frequent script decides, the earlier one on a tie. Latin documents list
    the languages of their pages by frequency with English appended, at most four.
    """
    sample = pages.filter(F.col("page_no") <= sample_pages)
    # The script travels as part of the key, so the text is read once.
    keys = ["doc_id", "page_no", "script"]
    guessed = guess_language(sample.withColumn("script", script("text")), keys)
    guess = F.when(F.col("script") == "Latin", F.col("language")).alias("guess")
    # A document has one entry per sampled page.
    entries = (
        guessed.select(*keys, guess)
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("page_no", "script", "guess"))).alias("e"))
        .select(
            "doc_id",
            _by_frequency(F.transform("e", lambda e: e["script"])).alias("scripts"),
            _by_frequency(F.transform("e", lambda e: e["guess"])).alias("guesses"),
        )
    )
    listed = F.coalesce("guesses", F.array().cast("array<string>"))
    with_english = F.when(F.array_contains(listed, "eng"), listed).otherwise(
        F.concat(listed, F.array(F.lit("eng")))
    )
    latin = F.array_join(F.slice(with_english, 1, C.MAX_LANGUAGES), "+")
    language = (
        F.when(F.col("script").isNull(), fallback)
        .when(F.col("script") == "Latin", latin)
        .otherwise(script_language("script"))
    )
    return (
        pages.select("doc_id")
        .distinct()
        .join(entries, "doc_id", "left")
        .withColumn("script", F.get("scripts", F.lit(0)))
        .select(
            "doc_id",
            language.alias("language"),
            "script",
            F.col("script").isNotNull().alias("detected"),
        )
    )


def _by_frequency(values: Column) -> Column:
    """Distinct values of a short array, the most frequent first, then the earliest."""

    def ranked(known: Column) -> Column:
        def rank(value: Column) -> Column:
            copies = F.size(F.filter(known, lambda other: other == value))
            return F.struct(
                (-copies).alias("n"), F.array_position(known, value).alias("at"), value.alias("v")
            )

        order = F.array_sort(F.transform(F.array_distinct(known), rank))
        return F.transform(order, lambda entry: entry["v"])

    return let(F.array_compact(values), ranked)
