"""All queries and SQL of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans import corpus_queries, incremental_queries, retrieval_queries

MODULES = (retrieval_queries, corpus_queries, incremental_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.oracle_sql().items()}
