"""Registry of the queries the driver runs: name -> (spark plan, DuckDB twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register themselves."""
    from pagecorpus.plans import q_clean, q_extract, q_jobs, q_metrics, q_pages, q_policy, q_process, q_profiles, q_requests, q_safety, q_schema, q_store, q_stream, q_urls, q_variants  # noqa: F401
