"""Queries by name, and the SQL that states each one's result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import bank, cases, documents, events, landed, pages, papers, streams, tables

FLAGSHIP = "furniture_lines"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _plan in (documents, pages, tables, events, streams, cases, bank, landed, papers):
    QUERIES |= _plan.QUERIES
    ORACLE_SQL |= _plan.ORACLE_SQL
