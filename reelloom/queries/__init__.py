"""Queries over the driver's tables, by name, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelloom.queries import catalog, intake, merges, problems, scalars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in (problems, catalog, scalars, merges, intake):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
