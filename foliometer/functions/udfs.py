"""The few scalar functions Spark has no expression for (Arrow batches)."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections import Counter
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DIFF_LINES, UNCHANGED_RATIO
from .matching import below, ratio
from .text import SPACE

# A changed line of a diff; one that starts with three marks counts as a heading.
CHANGE = re.compile(r"\+(?!\+\+)|-(?!--)")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """U4: compatibility composition; NULL stays NULL."""
    return text.map(lambda value: unicodedata.normalize("NFKC", value), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity of two texts in [0, 1]; NULL on the left stays NULL."""
    pairs = zip(left, right, strict=True)
    return pd.Series([None if a is None else ratio(a, b) for a, b in pairs], dtype="float64")


@F.pandas_udf(T.BooleanType())
def differs(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether two texts are less than 99.9 % similar; NULL on the left stays NULL."""
    pairs = zip(left, right, strict=True)
    found = [None if a is None else below(a, b, UNCHANGED_RATIO) for a, b in pairs]
    return pd.Series(found, dtype="object")


def _diff_lines(left: str, right: str) -> list[str]:
    lines = difflib.unified_diff(left.splitlines(), right.splitlines(), lineterm="", n=0)
    return list(islice(filter(CHANGE.match, lines), DIFF_LINES))


@F.pandas_udf(T.ArrayType(T.StringType()))
def diff_lines(left: pd.Series, right: pd.Series) -> pd.Series:
    """First changed lines of two texts, marked + or -; NULL on the left stays NULL."""
    pairs = zip(left, right, strict=True)
    return pd.Series([None if a is None else _diff_lines(a, b) for a, b in pairs], dtype="object")


# Code points that can have a letter case lie below this one.
CASED = 0x1F000
SPACES, LONG_SPACES = re.compile(f"[{SPACE}]+"), re.compile(f"[{SPACE}]{{2,}}")


@lru_cache(maxsize=1)
def _one_case() -> dict[int, str]:
    """Each letter by the lower case of its upper case, where both are single characters.

    One character stays one character, so places in a text do not move.
    """
    table = {}
    for code in range(CASED):
        letter = chr(code)
        folded = letter.upper().lower()
        if len(folded) > 1:
            folded = letter.lower()
        if len(folded) == 1 and folded != letter:
            table[code] = folded
    return table


def normal_text(text: str) -> tuple[str, np.ndarray | None]:
    """Text in one letter case with single blanks, and the place of each of its characters
    in ``text``; no places where none has moved."""
    folded = text.translate(_one_case())
    normal = SPACES.sub(" ", folded)
    if len(normal) == len(text):
        return normal, None
    kept = np.ones(len(text), bool)
    for run in LONG_SPACES.finditer(folded):
        kept[run.start() + 1 : run.end()] = False
    return normal, np.flatnonzero(kept)


class Terms:
    """Redaction terms of a document as one automaton over normal text."""

    def __init__(self, terms):
        self.forms = [normal_text(" ".join(SPACES.split(term)))[0] for term in terms]
        self.automaton = ahocorasick.Automaton()
        for form in self.forms:
            self.automaton.add_word(form, form)
        self.automaton.make_automaton()

    def match(self, text: str) -> tuple[list[int], str]:
        """Occurrences per term, from left to right without overlap of its own, and the
        text without any of them."""
        normal, places = normal_text(text)
        hits, ends, spans = Counter(), {}, []
        for last, form in self.automaton.iter(normal):
            start = last + 1 - len(form)
            if start >= ends.get(form, 0):
                ends[form] = last + 1
                hits[form] += 1
                spans.append((start, last))
        kept, position = [], 0
        for start, last in sorted(spans):
            # Terms neither start nor end with white space, so both ends have a place.
            if places is not None:
                start, last = places[start], places[last]
            kept.append(text[position:start])
            position = max(position, last + 1)
        kept.append(text[position:])
        return [hits[form] for form in self.forms], "".join(kept)


@lru_cache(maxsize=64)
def _terms_of(terms: tuple[str, ...]) -> Terms:
    return Terms(terms)


MATCH = T.StructType().add("hits", T.ArrayType(T.LongType())).add("clean", T.StringType())


@F.pandas_udf(MATCH)
def match_terms(text: pd.Series, terms: pd.Series) -> pd.DataFrame:
    """Hits of each term and the text without them, overlapping ones included.

    White space of any kind and length matches any other, and so do both cases of a letter.
    Without terms both are NULL; a NULL text has no hits and stays NULL.
    """
    found = []
    for value, wanted in zip(text, terms, strict=True):
        if wanted is None:
            found.append((None, None))
        elif value is None:
            found.append(([0] * len(wanted), None))
        else:
            found.append(_terms_of(tuple(wanted)).match(value))
    return pd.DataFrame(found, columns=["hits", "clean"])


# Unrolling the hits makes Spark infer a filter on them, for which it would call the function a
# second time, in a second worker, if it took it for deterministic.
match_terms = match_terms.asNondeterministic()
