"""Run a per-file Python function over binary rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

RESULT = "job_id string, position int, part int, output binary, error_code string, message string"
ARROW_RESULT = pa.schema(
    [
        ("job_id", pa.string()),
        ("position", pa.int32()),
        ("part", pa.int32()),
        ("output", pa.binary()),
        ("error_code", pa.string()),
        ("message", pa.string()),
    ]
)
# Bytes of results that a task sends on together.
RESULT_BYTES = 4 << 20
# Small results that a task sends on together.
RESULT_ROWS = 10_000


class FileError(Exception):
    """Raised by a per-file function to fail one file with a code of its own."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code
        self.message = message


PerFile = Callable[[bytes, str, int], bytes | list[bytes]]


class File(NamedTuple):
    job_id: str
    position: int
    name: str
    content: bytes


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), ARROW_RESULT, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=ARROW_RESULT)


def _outcome(fn: PerFile, row) -> Iterator[tuple]:
    """Result rows of one file; a failure is a row too."""
    try:
        produced = fn(row.content, row.name, row.position)
        parts = produced if isinstance(produced, list) else [produced]
        for part, output in enumerate(parts):
            yield row.job_id, row.position, part, output, None, None
    except FileError as error:
        yield row.job_id, row.position, None, None, error.code, error.message
    except Exception as error:  # one bad file must not fail the others
        message = f"Unexpected error: {error}"
        yield row.job_id, row.position, None, None, "INTERNAL_SERVER_ERROR", message


def batch_map(files: DataFrame, fn: PerFile) -> DataFrame:
    """Apply ``fn(content, name, position)`` to every row of ``files``.

    ``files(job_id, position, name, content)``. Each input yields no, one or several
    outputs (``part``); an exception becomes a row with ``error_code`` and ``message``
    and does not stop the job. Results keep ``position``, which restores input order.
    A task holds a batch of files and some megabytes of results, however many there are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                # One file at a time leaves the batch.
                (values,) = batch.slice(at, 1).to_pylist()
                for result in _outcome(fn, File(**values)):
                    rows.append(result)
                    size += len(result[3] or b"")
                    if size >= RESULT_BYTES or len(rows) >= RESULT_ROWS:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    inputs = files.select("job_id", F.col("position").cast("int"), "name", "content")
    return inputs.mapInArrow(run, RESULT)


def register_batch_function(spark: SparkSession, name: str, fn: PerFile) -> None:
    """Make ``fn`` a table function of SQL with the rows of ``batch_map``.

    ``SELECT … FROM name(TABLE(files))``; the argument has the columns of ``files``, in any
    order and among others. Rows are handled where they lie, without a shuffle, unless the
    call says ``PARTITION BY``.
    """

    class BatchFunction:
        def eval(self, row: Row):
            yield from _outcome(fn, row)

    spark.udtf.register(name, udtf(BatchFunction, returnType=RESULT))


def job_outcomes(results: DataFrame) -> DataFrame:
    """First failure fails the job: verdict per job over the rows of ``batch_map``."""
    failed = F.when(F.col("error_code").isNotNull(), F.struct("position", "error_code", "message"))
    return (
        results.groupBy("job_id")
        .agg(
            F.min(failed).alias("failure"),
            F.count_if(F.col("error_code").isNull()).alias("outputs"),
        )
        .select(
            "job_id",
            F.when(F.col("failure").isNull(), "completed").otherwise("failed").alias("status"),
            "failure.error_code",
            F.substring("failure.message", 1, 2000).alias("message"),
            "outputs",
        )
    )
