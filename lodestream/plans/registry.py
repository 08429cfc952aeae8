"""Queries by name with their SQL twins, collected by a decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.by_name: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a function (spark, folder) -> DataFrame under its own name."""

        def register(f: Query) -> Query:
            self.by_name[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return register

    def queries(self) -> dict[str, Query]:
        return dict(self.by_name)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self.sql)
