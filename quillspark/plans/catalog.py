"""Registry of the core queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import pipeline_plans, search_plans, table_plans, text_plans

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [text_plans, table_plans, search_plans, pipeline_plans]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of all stored queries."""
    return search_plans.hybrid_chunks(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
