"""Registered queries with their DuckDB SQL, by area."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
AREAS = ("text", "books", "voices", "jobs", "numbers", "narration", "plugins", "streams")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """(queries, SQL) of all areas."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for area in AREAS:
        module = import_module(f"narrata.catalog.{area}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
