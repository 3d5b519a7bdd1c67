"""Registry of the named queries and of the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Named queries, each with an optional independent SQL statement of the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, QueryFn] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
        def register(fn: QueryFn) -> QueryFn:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register
