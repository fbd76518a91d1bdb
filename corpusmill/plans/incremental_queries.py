"""Queries and SQL of incremental processing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators import incremental
from corpusmill.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.changed_documents(*(table(spark, folder, t) for t in ("crawl_results", "extracted_documents", "embed_results", "ingest_runs")))


P5_FOUND_SQL = """
WITH r AS (SELECT DISTINCT run_id, cutoff_at, started_at FROM ingest_runs),
u AS (SELECT DISTINCT document_id, url FROM extracted_documents),
f AS (SELECT r.run_id, u.document_id, lower(c.content_hash) AS hash,
        row_number() OVER (PARTITION BY r.run_id, u.document_id ORDER BY c.fetched_at DESC, c.fetch_id DESC) AS k
      FROM crawl_results AS c JOIN u ON c.url = u.url JOIN r ON c.arrived_at <= r.cutoff_at
      WHERE c.status = 'success' AND c.http_status = 200 AND c.content_hash IS NOT NULL AND c.body_bytes > 0),
e AS (SELECT r.run_id, x.document_id, lower(x.content_hash) AS hash,
        row_number() OVER (PARTITION BY r.run_id, x.document_id ORDER BY x.finished_at DESC, x.run_id DESC) AS k
      FROM embed_results AS x JOIN r ON x.finished_at < r.started_at WHERE x.skipped = false AND x.finished_at IS NOT NULL)
SELECT DISTINCT f.run_id, f.document_id FROM f LEFT JOIN e ON f.run_id = e.run_id AND f.document_id = e.document_id AND e.k = 1
WHERE f.k = 1 AND f.hash IS DISTINCT FROM e.hash"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p5_found": p5_found}


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_FOUND_SQL}
