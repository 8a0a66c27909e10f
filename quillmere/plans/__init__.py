"""The queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answers, evaluation, experiments, operations, reports, retrieval, sections, text

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (retrieval, text, answers, operations, experiments, evaluation, sections, reports)
QUERIES: dict[str, Query] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.SQL.items()} | sections.CHUNK_SQL
