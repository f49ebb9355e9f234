"""Shared pieces: stored tables, Arrow maps, word shingles and minima of hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, scratch

# Rows per Arrow batch. Texts vary from a word to many pages, so batches are small.
BATCH_ROWS = 1000
# Words a Python worker remembers the hash of; the table is emptied when it is full.
KNOWN_WORDS = 100_000
# Ids that may be broadcast to filter a table before its shuffle: 16 MB of them. With more,
# the table is shuffled to meet them.
BROADCAST_IDS = 2_000_000

MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
STEP = np.uint64(0x9E3779B97F4A7C15)


def prepare(spark: SparkSession) -> SparkSession:
    """The settings all operators here assume."""
    configure(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != str(BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # Row numbers come from the splits of a table. Their size must not change when an
    # executor is lost between two reads.
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        cores = spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(cores))
    return spark


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; survives lost executors."""
    folder = scratch(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def map_batches(
    df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], Iterator]], schema
) -> DataFrame:
    """Apply a function per Arrow batch; ``start`` makes it once per task.

    ``schema`` is a StructType, or text like "a long, b string".
    """
    if isinstance(schema, str):
        names = [field.split(" ")[0] for field in schema.split(", ")]
    else:
        names = schema.fieldNames()

    def run(batches):
        work = start()
        for batch in batches:
            if batch.num_rows:
                for columns in work(batch):
                    yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def long_lists(values: np.ndarray, lengths) -> pa.Array:
    """A column of arrays of longs from all their values and their lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


class WordHashes(dict):
    """64-bit hash of a word given as bytes, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    """The worker's table, kept from task to task."""
    return WordHashes()


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that all their bits depend on all bits."""
    shifted = values >> np.uint64(33)
    values = values ^ shifted
    for factor in (MIX_1, MIX_2):
        values *= factor
        values ^= np.right_shift(values, np.uint64(33), out=shifted)
    return values


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` consecutive entries; a shorter sequence is one run."""
    size = min(size, len(hashes))
    if not size:
        return hashes
    last = len(hashes) - size + 1
    run = hashes[:last].copy()
    for shift in range(1, size):
        run *= STEP
        run += hashes[shift : last + shift]
    return mixed(run + np.uint64(size))


def word_shingles(text: bytes, known: WordHashes, size: int) -> np.ndarray:
    """The distinct word shingles of a text, sorted.

    Letters A-Z are lower-cased; words are runs of bytes other than space and
    U+0009-U+000D, which is how ``bytes`` lowers and splits.
    """
    return np.unique(windows(known.of(text.lower().split()), size))


def multipliers(count: int) -> np.ndarray:
    """Odd 32-bit multipliers, each a permutation of the 32-bit hashes."""
    return (mixed(np.arange(1, count + 1, dtype=np.uint64) * STEP) >> np.uint64(32)).astype(
        np.uint32
    ) | np.uint32(1)


def without_clashes(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones cannot clash with working names."""
    return df.select(*[F.col(f"`{column}`") for column in columns])


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among ``ids``, a stored table of distinct keys.

    Up to BROADCAST_IDS keys are broadcast, so that wide rows are dropped before they
    are shuffled; beyond that both sides are shuffled. The rows are the same.
    """
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")
