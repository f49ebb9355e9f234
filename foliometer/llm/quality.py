"""Quality rules: compression bands over whole documents and fixed chunks.

Text that repeats itself compresses too well; noise, encoded data and random strings
compress too badly. A document is kept if its zstandard ratio (compressed bytes divided by
bytes) lies in the band for its length, and so do the ratios of its fixed chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, raw_texts, windows, without_clashes, word_hashes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
WINDOW = 5


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio by length in bytes.

    The default limits lie about 0.04 outside the ratios of labelled clean prose of the same
    length; markup and code need limits of their own.

    ``whole`` holds rows (least bytes, lowest ratio, highest ratio) in ascending order; a
    text shorter than the first row is judged by the base rules alone. ``chunk`` is the
    limits for chunks of ``chunk_bytes``; a last piece of less than half a chunk is part of
    the chunk before it. A document is rejected when more than ``bad_share`` percent of its
    chunks lie outside.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (100, 0.36, 1.15),
        (250, 0.48, 0.85),
        (500, 0.46, 0.76),
        (1000, 0.42, 0.67),
        (2000, 0.40, 0.62),
        (4000, 0.36, 0.57),
        (8000, 0.32, 0.53),
        (16000, 0.29, 0.51),
        (32000, 0.26, 0.50),
    )
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.36, 0.66)
    bad_share: int = 25
    level: int = 3


COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_bytes long, ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, "
    "kept boolean"
)


def repeat_words(hashes: np.ndarray) -> int:
    """Words that lie in a window of five which occurs twice or more, first ones included."""
    if len(hashes) < WINDOW:
        return 0
    runs = windows(hashes, WINDOW)
    _, which, counts = np.unique(runs, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    if not again.any():
        return 0
    covered = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(covered)))


def in_bands(text: bytes, bands: Bands, packer) -> tuple[float | None, int, int, bool]:
    """Ratio of the whole text, its chunks, those outside their limits, and the verdict."""
    size = len(text)
    if not size:
        return None, 0, 0, True
    ratio = len(packer.compress(text)) / size
    limits = next((row for row in reversed(bands.whole) if size >= row[0]), None)
    fits = limits is None or limits[1] <= ratio <= limits[2]
    step, chunks, bad = bands.chunk_bytes, 0, 0
    if size >= step:
        cuts = [*range(0, size - step // 2, step), size]
        for start, end in zip(cuts, cuts[1:], strict=False):
            part = len(packer.compress(text[start:end])) / (end - start)
            chunks += 1
            bad += not bands.chunk[0] <= part <= bands.chunk[1]
    return ratio, chunks, bad, fits and 100 * bad <= bands.bad_share * chunks


def quality(docs: DataFrame, bands: Bands = Bands(), key: str = "doc_id") -> DataFrame:  # noqa: B008
    """One row per document with its base counts, ratios and verdict.

    Words are runs of characters other than space and U+0009-U+000D. ``base_failed`` holds
    for fewer than 10 words, or when over 20 % of the words lie in five-word windows found
    twice or more in the text. ``kept`` is false for these, and else says whether the ratios
    lie in their bands. A null text is empty, has no ratio and fails. Rows with equal or
    null keys are judged one by one; other columns are left out.
    """

    def start():
        packer = zstandard.ZstdCompressor(level=bands.level)
        known = word_hashes()

        def work(batch):
            out = []
            for text in raw_texts(batch.column(1)):
                words = text.split()
                n_words = len(words)
                solid = text.translate(None, SPACES)
                word_chars = len(solid.decode())
                n_symbols = len(solid) - len(solid.translate(None, SYMBOLS))
                lines = [line for line in text.split(b"\n") if line and not line.isspace()]
                repeated = repeat_words(known.of(words))
                failed = n_words < 10 or 100 * repeated > 20 * n_words
                ratio, chunks, bad, fits = in_bands(text, bands, packer)
                out.append((n_words, word_chars, n_symbols, len(lines) - len(set(lines)), repeated,
                            len(text), ratio, chunks, bad, failed, fits and not failed))
            columns = zip(*out, strict=True)
            kinds = [pa.int64()] * 6 + [pa.float64()] + [pa.int64()] * 2 + [pa.bool_()] * 2
            yield [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]

        return work

    rows = without_clashes(docs, key, "text")
    kind = rows.schema[key].dataType.simpleString()
    return map_batches(rows, start, f"{key} {kind}, {COLUMNS}")


def kept_documents(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that the rules keep, all columns and repeated rows included.

    Filters in one pass, without a join: the verdict is taken batch by batch where the rows
    lie.
    """
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches):
        packer, known = zstandard.ZstdCompressor(level=bands.level), word_hashes()
        for batch in batches:
            keep = []
            for text in raw_texts(batch.column(at)):
                words = text.split()
                good = len(words) >= 10 and 100 * repeat_words(known.of(words)) <= 20 * len(words)
                keep.append(good and in_bands(text, bands, packer)[3])
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def rejected_share(judged: DataFrame) -> DataFrame:
    """How many documents each rule rejects."""
    return judged.agg(
        F.count("*").alias("n_docs"),
        F.count_if("base_failed").alias("n_base_failed"),
        F.count_if("NOT base_failed AND NOT kept").alias("n_outside_bands"),
    )
