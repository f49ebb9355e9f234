"""Visit ingest."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.enrich import classify_visits
from ..schemas import SCHEMAS


def visit_is_valid() -> Column:
    """Required fields present and all fields within their lengths."""
    checks = []
    for name, (low, high, required) in C.VISIT_LENGTHS.items():
        within = F.length(name).between(low, high)
        checks.append(F.coalesce(within, F.lit(not required)))
    return reduce(and_, checks)


def split_visits(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected raw visits."""
    valid = visit_is_valid()
    return raw.filter(valid), raw.filter(~valid)


def read_visit_stream(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Raw visits as files arrive in a folder."""
    return spark.readStream.schema(SCHEMAS["raw_visits"]).format(form).load(path)


def write_visits(raw_stream: DataFrame, target: str, quarantine: str, checkpoint: str):
    """Start two append queries: classified visits, and rejected rows as they came.

    The returning flag needs state per visitor; see ``streaming.visits``.
    """
    valid, rejected = split_visits(raw_stream)

    def start(rows: DataFrame, folder: str, name: str):
        writer = rows.writeStream.format("parquet").option("path", folder)
        return (
            writer.option("checkpointLocation", f"{checkpoint}/{name}")
            .trigger(availableNow=True)
            .start()
        )

    return start(classify_visits(valid), target, "visits"), start(
        rejected, quarantine, "quarantine"
    )
