"""Register of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table

#: The time that all queries take as now; the tables end with 2025.
NOW = "2026-01-01 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of one folder by name: ``t.giving_gifts``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Register a function of ``Tables`` under its own name, with the same question in SQL."""

        def enter(f: Callable[[Tables], DataFrame]):
            self.queries[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return enter
