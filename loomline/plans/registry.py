"""Named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with SQL for the same rows where SQL can express it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator that registers a query."""

        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add
