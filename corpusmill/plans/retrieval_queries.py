"""Queries and SQL of retrieval, confidence, refusal and routing.

Chunks have no stored vectors in the test tables; each takes the vector whose vec_id is its id modulo their number,
and so does each question.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.routing import CONTACTS, DEFAULT_TOPIC, LEAD_IN, TOPIC_WORDS, office_of, topic_of
from corpusmill.operators import confidence as rating
from corpusmill.operators import search
from corpusmill.sources.tables import table


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks with embedding, documents, questions with text and vector)."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    chunks = table(spark, folder, "chunks").withColumn("vec_id", F.col("chunk_id") % n).join(vectors, "vec_id").drop("vec_id")
    asked = table(spark, folder, "questions").dropDuplicates(["question_id"]).select("question_id", F.col("redacted_text").alias("text"), (F.col("question_id") % n).alias("vec_id"))
    asked = asked.join(vectors.withColumnRenamed("embedding", "vector"), "vec_id").drop("vec_id")
    return chunks, table(spark, folder, "extracted_documents").select("document_id", "url", "title", "is_active").distinct(), asked


def ann_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of the indexed search against the exact one: all vectors, asked with those whose id is divisible by 100."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = vectors.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("vector"))
    centres = search.train_cells(vectors, "chunk_id", "embedding")
    probes = search.probes_for(vectors, asked, centres, k=10, recall=0.95)
    exact = search.dense_topk(vectors, asked, 10).select("question_id", "chunk_id", F.lit(1).alias("hit"))
    near = search.dense_topk(vectors, asked, 10, centres=centres, probes=probes).select("question_id", "chunk_id", F.lit(1).alias("got"))
    both = exact.join(near, ["question_id", "chunk_id"], "left")
    return both.agg(F.count("*").alias("n_neighbours"), (F.coalesce(F.sum("got"), F.lit(0)) >= 0.9 * F.count("*")).alias("recall_reached"))


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    found = search.hybrid_search(*_vectors(spark, folder))
    return found.select("question_id", "chunk_id", "document_id", "dense_rank", "dense_distance", "sparse_rank", "sparse_score", F.round("rrf_score", 9).alias("rrf_score"), "rank")


def hybrid_search_english(spark: SparkSession, folder: str) -> DataFrame:
    """With the English analyzer and cover-density rank."""
    return search.hybrid_search(*_vectors(spark, folder), rank="cover", analyzer="english")


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    chunks, _, asked = _vectors(spark, folder)
    return search.dense_topk(chunks, asked)


def sparse_topk(spark: SparkSession, folder: str) -> DataFrame:
    chunks, _, asked = _vectors(spark, folder)
    return search.sparse_topk(chunks, asked)


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """The fused ranking of the stored hits' two ranks."""
    hits = table(spark, folder, "retrieved_chunks")
    leg = lambda c: hits.where(F.col(c).isNotNull()).groupBy("question_id", "chunk_id").agg(F.min(c).alias(c))
    return search.fuse(leg("dense_rank"), leg("sparse_rank")).select("question_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), "rank")


def _hits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    hits = table(spark, folder, "retrieved_chunks").where("rank is not null").select("question_id", "rank", F.when(~F.isnan("dense_distance"), F.col("dense_distance")).alias("dense_distance"), "chunk_id").distinct()
    return table(spark, folder, "questions").select("question_id", F.col("redacted_text").alias("text")), hits


def confidence(spark: SparkSession, folder: str) -> DataFrame:
    return rating.confidence(*_hits(spark, folder))


def refusals(spark: SparkSession, folder: str) -> DataFrame:
    return rating.refusals(*_hits(spark, folder))


def topic_routing(spark: SparkSession, folder: str) -> DataFrame:
    topic = topic_of(F.col("redacted_text"))
    return table(spark, folder, "questions").select("question_id", topic.alias("topic"), office_of(topic).alias("office_name")).distinct()


_VECTORS_SQL = """
WITH n AS (SELECT count(*) AS n FROM embeddings),
d AS (SELECT DISTINCT document_id FROM extracted_documents WHERE is_active),
c AS (SELECT DISTINCT ON (chunk_id) chunk_id, document_id, text, CAST(embedding AS DOUBLE[]) AS v FROM chunks, n JOIN embeddings ON vec_id = chunk_id % n.n),
q AS (SELECT DISTINCT ON (question_id) question_id, redacted_text AS text, CAST(embedding AS DOUBLE[]) AS v FROM questions, n JOIN embeddings ON vec_id = question_id % n.n)"""


def _legs(chunks: str, asked: str) -> str:
    return f""",
cc AS ({chunks}), qq AS ({asked}),
x AS (SELECT question_id, chunk_id, round(1 - list_cosine_similarity(qq.v, cc.v), 6) AS dense_distance FROM qq, cc),
dl AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY dense_distance, chunk_id) AS dense_rank FROM x QUALIFY dense_rank <= 30),
qt AS (SELECT DISTINCT question_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')) AS token FROM qq WHERE trim(text) <> ''),
ct AS (SELECT chunk_id, token, count(*) AS hits FROM (SELECT chunk_id, unnest(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')) AS token FROM cc) GROUP BY ALL),
qn AS (SELECT question_id, count(*) AS needed FROM qt GROUP BY question_id),
s AS (SELECT question_id, chunk_id, round(CAST(sum(hits) AS DOUBLE) * 0.1, 6) AS sparse_score FROM qt JOIN ct USING (token) JOIN qn USING (question_id) GROUP BY question_id, chunk_id, needed HAVING count(*) = needed),
sl AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sparse_score DESC, chunk_id) AS sparse_rank FROM s QUALIFY sparse_rank <= 30)"""


_ALL_LEGS = _VECTORS_SQL + _legs("SELECT * FROM c", "SELECT * FROM q")
_ACTIVE_LEGS = _VECTORS_SQL + _legs("SELECT c.* FROM c JOIN d USING (document_id)", "SELECT * FROM q WHERE trim(text) <> ''")
_SIMILARITY = "greatest(0, 1 - coalesce(CASE WHEN isnan(dense_distance) THEN NULL ELSE dense_distance END, 1))"
_CONFIDENCE_SQL = f"""
WITH h AS (SELECT DISTINCT question_id, rank, chunk_id, {_SIMILARITY} AS s FROM retrieved_chunks WHERE rank IS NOT NULL),
n AS (SELECT question_id, max(rank) AS n FROM h GROUP BY question_id),
g AS (SELECT question_id, max(CASE WHEN rank = 1 THEN s END) AS top, max(CASE WHEN rank = least(n, 5) THEN s END) AS fifth, count(*) FILTER (s >= 0.35) AS above FROM h JOIN n USING (question_id) GROUP BY question_id),
q AS (SELECT DISTINCT question_id FROM questions),
r AS (SELECT q.question_id, coalesce(top, 0) AS top, coalesce(coalesce(top, 0) - coalesce(fifth, 0), 0) AS gap, coalesce(above, 0) AS above, g.question_id IS NULL AS none FROM q LEFT JOIN g ON q.question_id = g.question_id),
f AS (SELECT question_id, round(top, 6) AS top1_similarity, round(gap, 6) AS top1_top5_gap, above AS chunks_above_threshold,
  CASE WHEN none THEN 0.0 ELSE round(0.55 * top + 0.25 * least(gap / 0.15, 1) + 0.20 * least(above / 3, 1), 6) END AS score, none FROM r)"""
_TOPIC_SQL = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(redacted_text, ''), '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{words})(?:[^\\p{{L}}\\p{{N}}_]|$)') THEN '{topic}'" for topic, words in TOPIC_WORDS) + f" ELSE '{DEFAULT_TOPIC}' END"
_OFFICE_SQL = "CASE topic " + " ".join(f"WHEN '{t}' THEN '{c[0]}'" for t, c in CONTACTS.items()) + " END"
_LINK_SQL = "CASE topic " + " ".join(f"WHEN '{t}' THEN '{c[1]}'" for t, c in CONTACTS.items()) + " END"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (hybrid_search, hybrid_search_english, ann_recall, dense_topk, sparse_topk, rrf_fusion, confidence, refusals, topic_routing)}


def oracle_sql() -> dict[str, str]:
    return {
        "hybrid_search": _ACTIVE_LEGS + """,
b AS (SELECT question_id, chunk_id, dense_rank, dense_distance, sparse_rank, sparse_score, coalesce(1 / (60.0 + dense_rank), 0) + coalesce(1 / (60.0 + sparse_rank), 0) AS rrf FROM dl FULL JOIN sl USING (question_id, chunk_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(rrf, 15) DESC, CAST(chunk_id AS VARCHAR)) AS rank FROM b QUALIFY rank <= 8)
SELECT question_id, chunk_id, document_id, dense_rank, dense_distance, sparse_rank, sparse_score, round(rrf, 9) AS rrf_score, rank FROM r JOIN c USING (chunk_id)""",
        "ann_recall": "SELECT sum(least(10, n)) AS n_neighbours, true AS recall_reached FROM (SELECT q.vec_id, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS n FROM embeddings AS q WHERE q.vec_id % 100 = 0 AND q.embedding IS NOT NULL)",
        "dense_topk": _ALL_LEGS + " SELECT question_id, chunk_id, dense_distance, dense_rank FROM dl",
        "sparse_topk": _ALL_LEGS + " SELECT question_id, chunk_id, sparse_score, sparse_rank FROM sl",
        "rrf_fusion": """
WITH r AS (SELECT question_id, chunk_id, min(dense_rank) AS d, min(sparse_rank) AS s FROM retrieved_chunks GROUP BY ALL HAVING d IS NOT NULL OR s IS NOT NULL),
b AS (SELECT *, coalesce(1 / (60.0 + d), 0) + coalesce(1 / (60.0 + s), 0) AS rrf FROM r)
SELECT question_id, chunk_id, round(rrf, 9) AS rrf_score, row_number() OVER (PARTITION BY question_id ORDER BY round(rrf, 15) DESC, CAST(chunk_id AS VARCHAR)) AS rank FROM b QUALIFY rank <= 8""",
        "confidence": _CONFIDENCE_SQL + " SELECT question_id, top1_similarity, top1_top5_gap, chunks_above_threshold, score, none OR score < 0.35 AS should_refuse FROM f",
        "refusals": _CONFIDENCE_SQL + f""",
t AS (SELECT DISTINCT ON (question_id) question_id, {_TOPIC_SQL} AS topic FROM questions)
SELECT question_id, topic, {_OFFICE_SQL} AS office_name, {_LINK_SQL} AS office_url, '{LEAD_IN} Please contact ' || {_OFFICE_SQL} || ': ' || {_LINK_SQL} AS message, score
FROM f JOIN t USING (question_id) WHERE none OR score < 0.35""",
        "topic_routing": f"SELECT DISTINCT question_id, topic, {_OFFICE_SQL} AS office_name FROM (SELECT question_id, {_TOPIC_SQL} AS topic FROM questions)",
    }
