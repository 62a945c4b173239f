"""Registered queries over the given tables, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where SQL can express it."""
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return register


def load() -> None:
    from . import chunk_queries, conversation_queries, evaluation_queries  # noqa: F401
    from . import lookup_queries, rule_queries, search_queries, source_queries, text_queries  # noqa: F401
