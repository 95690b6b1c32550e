"""Queries over the driver's tables, each beside the SQL that says what to find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self):
        self._queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self._sql: dict[str, str] = {}

    def query(self, sql: str):
        """Registers a function of the reader of tables under its own name."""

        def register(f):
            self._queries[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            self._sql[f.__name__] = sql
            return f

        return register

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)
