"""Runnable queries over the sample tables, each with the SQL that states its expected result."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("pages", "topics", "requests", "robots", "results", "metrics", "search", "streams")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        found.update(import_module(f"pagemill.catalog.{name}").QUERIES)
    return found


def expected_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    # All modules first: some state the SQL of queries that others register.
    modules = [import_module(f"pagemill.catalog.{name}") for name in MODULES]
    for module in modules:
        found.update(module.SQL)
    return found
