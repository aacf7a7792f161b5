"""Registry of inventory keys: a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where SQL can state the answer, the equivalent DuckDB SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate key {key}")
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register keys (idempotent)."""
    from deckflow.plans import q_engagement, q_feed, q_functions, q_ingest, q_search, q_stream, q_viewer  # noqa: F401
