"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import image_queries, kernel_queries, registry, run_queries, source_queries, store_queries, stream_queries, track_queries

__all__ = ["image_queries", "kernel_queries", "oracle_sql", "queries", "run_queries", "source_queries", "store_queries", "stream_queries", "track_queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
