"""Ordered folds over groups of any length.

Rows are brought together by key and sorted; every task runs through its groups piece by
piece. A group longer than an Arrow batch is folded over its pieces with the state carried
on, so it never lies whole in memory; Spark's sort spills to disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ordered_fold(
    df: DataFrame, keys, order, schema: T.StructType,
    begin: Callable[[tuple], Any], step: Callable[[Any, dict[str, list]], Any],
    finish: Callable[[tuple, Any], Iterator[tuple]],
) -> DataFrame:
    """Fold the rows of every group in order.

    ``begin(key)`` gives the state of a new group, ``step(state, columns)`` the state after some
    more of its rows, given as lists by column name, and ``finish(key, state)`` result rows of
    ``schema``. Null keys form a group like any other. An empty table gives no rows.
    """
    keys = list(keys)
    arrow = to_arrow_schema(schema)

    def run(batches):
        key, state, out = None, None, []

        def ready():
            columns = zip(*out, strict=True)
            arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            for names, part in pieces(batch, keys):
                if names != key:
                    if key is not None:
                        out += finish(key, state)
                    key, state = names, begin(names)
                state = step(state, part.to_pydict())
            if len(out) >= batch.num_rows:
                yield ready()
                out = []
        if key is not None:
            out += finish(key, state)
        if out:
            yield ready()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of each run of equal keys in a batch."""
    if not batch.num_rows:
        return
    codes = [batch.column(key).dictionary_encode("encode").indices.to_numpy() for key in keys]
    changed = np.any([code[1:] != code[:-1] for code in codes], axis=0)
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
    for first, last in zip(cuts, cuts[1:], strict=False):
        names = tuple(batch.column(key)[first].as_py() for key in keys)
        yield names, batch.slice(first, last - first)
