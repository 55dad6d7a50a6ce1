"""Where queries and the SQL that they are compared with are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query. In its SQL, {memories} and the like stand for the derived tables."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            text = sql
            for table, body in tables.SQL.items():
                text = text.replace("{" + table + "}", f"({body})")
            SQL[name] = text
        return f

    return add
