"""Registering queries: a Spark callable over named tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.tables import table


class Tables:
    """The tables of a data directory as attributes."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.sf, name)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[name] = lambda spark, sf: f(Tables(spark, sf))
            if sql:
                self.sql[name] = sql
            return f

        return register
