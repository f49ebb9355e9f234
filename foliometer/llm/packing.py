"""Best-fit packing of documents into sequences: best-two-fit.

A sequence is filled greedily: the longest open piece, then again and again the longest one
that fits the gap. Then its smallest piece is taken out if two open pieces fit the widened
gap more tightly, and they take its place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored, without_clashes
from .tokens import vocabulary, word_ids

# Pieces that one task packs together. A group leaves about one sequence unfilled, one
# in many thousand, so groups cost next to nothing in sequences.
GROUP = 200_000
CAPACITY = 2048


def token_pieces(
    docs: DataFrame, path: str | None = None, end: int | None = 0, capacity: int = CAPACITY,
    key: str = "doc_id", keep_ids: bool = False,
) -> DataFrame:
    """Cut the ids of each document into pieces of at most ``capacity``.

    Returns (key, piece, start, length, ids_crc32), with ``ids`` as little-endian unsigned
    32-bit integers where ``keep_ids`` is set. A null text is empty and has only the end id;
    without an end id it has no piece. Repeated rows are cut one by one.
    """
    path = path or vocabulary()

    def start():
        known = word_ids(path)

        def work(batch):
            ids, lengths = known.of(batch.column(1), end)
            at, rows, out = 0, [], [[] for _ in range(5)]
            for row, length in enumerate(lengths.tolist()):
                for piece, first in enumerate(range(0, length, capacity)):
                    size = min(capacity, length - first)
                    data = ids[at + first : at + first + size].astype("<u4").tobytes()
                    rows.append(row)
                    for column, value in zip(out, (piece, first, size, zlib.crc32(data), data), strict=True):
                        column.append(value)
                at += length
            kinds = [pa.int32(), *[pa.int64()] * 3, pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield [batch.column(0).take(pa.array(rows, pa.int64())), *columns[: 4 + keep_ids]]

        return work

    rows = without_clashes(docs, key, "text")
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, piece int, start long, length long, ids_crc32 long"
    return map_batches(rows, start, schema + ", ids binary" * keep_ids)


class OpenPieces:
    """How many pieces of each length are open, and the longest up to any length."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.capacity = capacity
        order = np.argsort(lengths, kind="stable")
        self.order = order
        self.counts = np.bincount(lengths, minlength=capacity + 1)
        self.next = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        # best[n]: the longest open length that is at most n, 0 if none is.
        self.best = np.maximum.accumulate(
            np.where(self.counts > 0, np.arange(capacity + 1), 0)
        )

    def pair(self, space: int, more_than: int) -> tuple[int, int] | None:
        """The two open lengths of the largest sum that fits ``space`` and beats ``more_than``."""
        first = np.flatnonzero(self.counts[: space + 1])
        first = first[first > 0]
        second = self.best[space - first]
        # The same length twice needs two open pieces.
        alone = (second == first) & (self.counts[first] < 2)
        second = np.where(alone, self.best[np.maximum(first - 1, 0)], second)
        sums = np.where(second > 0, first + second, 0)
        if not len(sums) or sums.max() <= more_than:
            return None
        at = int(np.argmax(sums))
        return int(first[at]), int(second[at])


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; lengths lie in 1..capacity."""
    open_pieces = OpenPieces(lengths, capacity)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left, number = len(lengths), 0
    while left:
        chosen: list[int] = []
        gap = capacity
        while gap and (length := int(open_pieces.best[gap])):
            chosen.append(length)
            gap -= length
            open_pieces.counts[length] -= 1
            if not open_pieces.counts[length]:
                _close(open_pieces, length)
        if gap and len(chosen) > 1:
            smallest = chosen[-1]
            if better := open_pieces.pair(gap + smallest, smallest):
                _reopen(open_pieces, smallest)
                chosen[-1:] = better
                for length in better:
                    open_pieces.counts[length] -= 1
                    if not open_pieces.counts[length]:
                        _close(open_pieces, length)
        at = 0
        for length in chosen:
            piece = open_pieces.order[open_pieces.next[length]]
            open_pieces.next[length] += 1
            sequence[piece], offset[piece] = number, at
            at += length
        left -= len(chosen)
        number += 1
    return sequence, offset


def _close(pieces: OpenPieces, length: int) -> None:
    """No piece of this length is open any more."""
    reach = int(np.searchsorted(pieces.best, length, side="right"))
    pieces.best[length:reach] = pieces.best[length - 1]


def _reopen(pieces: OpenPieces, length: int) -> None:
    """A piece of this length is open again."""
    pieces.counts[length] += 1
    if pieces.counts[length] == 1:
        reach = int(np.searchsorted(pieces.best, length, side="left"))
        pieces.best[length : max(reach, length + 1)] = np.maximum(
            pieces.best[length : max(reach, length + 1)], length
        )


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP,
    order: tuple[str, ...] = ("doc_id", "piece"),
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces``, which have a ``length``.

    Pieces are dealt by a hash of ``order`` over groups of about ``group`` pieces. A group
    is held by one task as its rows, without texts or ids. Pieces whose length is null or
    outside 1..capacity raise an error. Equal rows are packed one by one. An empty table
    gives an empty one.
    """
    pieces = stored(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group))
    # Equal keys would all fall into one group; the part of a piece in the table's own order
    # spreads them. The table is stored, so this order does not change.
    spread = F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    dealt = pieces.withColumn("__group", spread).repartition(groups, "__group")
    columns = pieces.columns
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    sort = ["__group", *order, *[c for c in columns if c not in order]]

    def run(batches):
        def finish(parts):
            table = pa.Table.from_batches(parts)
            number = table.column("__group")[0].as_py()
            lengths = table.column("length").to_numpy().astype(np.int64)
            if (lengths < 1).any() or (lengths > capacity).any():
                raise ValueError(f"piece lengths must lie in 1..{capacity}")
            sequence, offset = best_two_fit(lengths, capacity)
            table = table.select(columns)
            table = table.append_column("sequence_id", pa.array(sequence + (number << 40)))
            return table.append_column("offset", pa.array(offset)).to_batches()

        parts, current = [], None
        for batch in batches:
            numbers = batch.column("__group").to_numpy()
            for value in np.unique(numbers):
                if parts and value != current:
                    yield from finish(parts)
                    parts = []
                current = value
                parts.append(batch.filter(pa.array(numbers == value)))
        if parts:
            yield from finish(parts)

    return dealt.sortWithinPartitions(*sort).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token pieces of all documents with their places in sequences."""
    return pack(token_pieces(docs, path))
