"""Tables with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.filters import timestamp
from ..schemas import SCHEMAS


def read_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Full scan of a product table in Parquet, without schema inference."""
    return spark.read.schema(SCHEMAS[table]).parquet(path)


def append_table(df: DataFrame, table: str, path: str) -> None:
    """Append rows in the table's column order."""
    df.select(*SCHEMAS[table].fieldNames()).write.mode("append").parquet(path)


def missing_rows(seed: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Seed rows whose key is not present yet; appending them is idempotent."""
    return seed.join(existing.select(key), key, "left_anti")


def tool_catalogue(spark: SparkSession) -> DataFrame:
    """The tool configurations a new installation starts with."""
    rows = [(*entry, order) for order, entry in enumerate(C.TOOL_CATALOGUE)]
    columns = "slug string, name string, category string, file_limit_mb int, sort_order int"
    flags = {"enabled": F.lit(True), "visible": F.lit(True), "maintenance": F.lit(False)}
    return spark.createDataFrame(rows, columns).withColumns(flags)


def audit_rows(
    changes: DataFrame, action: str, summary: Column, now, category: str = "audit", **columns
) -> DataFrame:
    """One audit row per changed row, ready to be appended.

    ``columns`` may give ``actor_id``, ``actor_email``, ``entity_type``, ``entity_id``,
    ``ip`` and ``meta`` as columns. The id is derived from the row, so that writing a
    batch twice yields the same ids.
    """
    none = F.lit(None).cast("string")
    optional = ("actor_id", "actor_email", "entity_type", "entity_id", "ip")
    given = {name: columns.get(name, none).cast("string") for name in optional}
    identity = F.concat_ws(
        "|", F.lit(action), F.lit(str(now)), *[given[name] for name in optional], summary
    )
    return changes.select(
        F.substring(F.sha2(identity, 256), 1, 32).alias("id"),
        F.lit(action).alias("action"),
        F.lit(category).alias("category"),
        summary.alias("summary"),
        timestamp(now).alias("created_at"),
        *[column.alias(name) for name, column in given.items()],
        F.coalesce(columns.get("meta", none).cast("string"), F.lit("{}")).alias("meta"),
    )
