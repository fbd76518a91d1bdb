"""Schemas of the persistent tables, as DDL; ids are strings or numbers given by the source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

TABLES = {
    "documents": "id STRING, url STRING, title STRING, content_hash STRING, etag STRING, http_status INT, content_type STRING, fetched_at TIMESTAMP, is_active BOOLEAN, embedded_hash STRING",
    "chunks": "id STRING, document_id STRING, ordinal INT, heading_path STRING, text STRING, token_count INT, url_anchor STRING, char_start INT, char_end INT, embedding ARRAY<FLOAT>, tsv MAP<STRING,ARRAY<INT>>",
    "questions": "id STRING, redacted_text STRING, topic_label STRING, retrieval_confidence FLOAT, was_refused BOOLEAN, had_conflict BOOLEAN, asked_at TIMESTAMP",
    "clusters": "id STRING, week_start DATE, label STRING, size INT, mean_confidence FLOAT, refusal_rate FLOAT, sample_questions ARRAY<STRING>",
    "conflicts": "id STRING, fact_key STRING, values ARRAY<STRUCT<value:STRING,document_id:STRING,url:STRING>>, first_seen TIMESTAMP, resolved BOOLEAN",
}
#: Columns that would identify a person; the question log has none of them.
IDENTITY_COLUMNS = frozenset("user_id student_id email name ip_address session_id device_id".split())


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def conformed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the table's columns in order and type; missing ones are null, others are left out."""
    from pyspark.sql import functions as F

    there = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])
