"""Registered queries: a Spark function, its result columns, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .testdata import raw, view, with_views

SPARK_TYPES = {"s": "string", "i": "bigint", "f": "double", "b": "boolean"}
SQL_TYPES = {"s": "VARCHAR", "i": "BIGINT", "f": "DOUBLE", "b": "BOOLEAN"}


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


class Tables:
    """Attribute access to test tables and adapter views of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.folder, name)

    def raw(self, name: str) -> DataFrame:
        return raw(self.spark, self.folder, name)


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(word.split(":")) for word in spec.split()]


def _spark_column(name: str, kind: str):
    if kind == "t":
        return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)
    return F.col(name).cast(SPARK_TYPES[kind]).alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "t":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"
    return f"CAST({name} AS {SQL_TYPES[kind]}) AS {name}"


def query(name: str, columns: str, views: str = "", sql: str | None = None):
    """Register a function of ``Tables``; both engines return exactly ``columns``.

    Column kinds: s string, i bigint, f double, b boolean, t timestamp as text.
    """
    spec = _columns(columns)

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            result = fn(Tables(spark, folder))
            return result.select(*[_spark_column(column, kind) for column, kind in spec])

        text = None
        if sql is not None:
            selected = ", ".join(_sql_column(column, kind) for column, kind in spec)
            text = f"SELECT {selected} FROM (\n{with_views(sql, *views.split())}\n) AS result"
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(run, text)
        return fn

    return register
