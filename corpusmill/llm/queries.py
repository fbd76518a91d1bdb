"""Queries and SQL of the operators in this package, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm import boilerplate, encoding, mixing, near_duplicates, rank_fusion, residue, site_lines, splitting, subjects
from corpusmill.plans.corpus_queries import newest_and_known
from corpusmill.plans.pipeline import ingest
from corpusmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Fetched pages and extracted documents that hold template residue or error-page text."""
    pages = residue.residue_in_pages(table(spark, folder, "crawl_results")).select(F.lit("crawl").alias("kind"), "record_id")
    texts = residue.residue_in_texts(table(spark, folder, "extracted_documents")).select(F.lit("extracted").alias("kind"), "record_id")
    return pages.unionByName(texts)


def p1_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The records left for the ingest: pages with a body and extracted documents without residue."""
    pages = residue.pages_without_residue(table(spark, folder, "crawl_results").where("body is not null")).select(F.lit("crawl").alias("kind"), F.col("fetch_id").alias("record_id"))
    texts = residue.without_residue(table(spark, folder, "extracted_documents")).select(F.lit("extracted").alias("kind"), F.col("document_id").alias("record_id"))
    return pages.unionByName(texts).distinct()


def ingest_states(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by state after all kept pages went through the pipeline, those with residue left out of it."""
    newest, known = newest_and_known(spark, folder)
    found = residue.residue_in_pages(newest).select(F.col("record_id").alias("fetch_id"))
    return ingest(newest, known, excluded=newest.join(found, "fetch_id", "left_semi").select("url", "content_hash")).summary


def _sample(spark: SparkSession, folder: str) -> list[tuple[str, boilerplate.Row]]:
    return boilerplate.sample_documents(table(spark, folder, "extracted_documents"), table(spark, folder, "crawl_results"))


def _furniture(spark: SparkSession, folder: str) -> boilerplate.Furniture:
    return boilerplate.trained([row for _, row in _sample(spark, folder)])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of extracted documents that are page furniture."""
    return boilerplate.furniture_lines(table(spark, folder, "extracted_documents"), _furniture(spark, folder), table(spark, folder, "crawl_results"))


def p2_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The main body of every page with a body."""
    return boilerplate.main_bodies(table(spark, folder, "crawl_results"), _furniture(spark, folder))


def p2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Precision and recall of nodes and lines on hosts kept out of the training (a report over the bounded sample)."""
    return spark.createDataFrame(boilerplate.held_out(_sample(spark, folder)), "what string, n bigint, precision double, recall double")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items over 2,400 characters: those that the splitter cut."""
    chunks = splitting.split_oversized(table(spark, folder, "chunks"), ["document_id", "ordinal"])
    blocks = splitting.split_oversized(table(spark, folder, "extract_blocks"), ["document_id", "block_no"])
    one = lambda df, kind, no: df.where("piece_no = 1").select(F.lit(kind).alias("kind"), "document_id", F.col(no).alias("item_no"))
    return one(blocks, "block", "block_no").unionByName(one(chunks, "chunk", "ordinal")).distinct()


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of the oversized chunks and blocks."""
    chunks = splitting.split_oversized(table(spark, folder, "chunks"), ["document_id", "ordinal"])
    blocks = splitting.split_oversized(table(spark, folder, "extract_blocks"), ["document_id", "block_no"])
    named = lambda df, kind, no: df.select(F.lit(kind).alias("kind"), "document_id", F.col(no).alias("item_no"), "piece_no", "char_start", "own_start", "char_end", "heading_path", "text")
    return named(blocks, "block", "block_no").unionByName(named(chunks, "chunk", "ordinal"))


P3_FOUND_SQL = """
SELECT DISTINCT 'block' AS kind, document_id, block_no AS item_no FROM extract_blocks WHERE length(text) > 2400
UNION ALL
SELECT DISTINCT 'chunk', document_id, ordinal FROM chunks WHERE length(text) > 2400"""


P3_CHECKS_SQL = """
SELECT DISTINCT 'block' AS kind, document_id, block_no AS item_no, 0 AS n_faults, length(text) AS covered FROM extract_blocks WHERE length(text) > 2400
UNION ALL
SELECT DISTINCT 'chunk', document_id, ordinal, 0, length(text) FROM chunks WHERE length(text) > 2400"""


def p3_checks(spark: SparkSession, folder: str) -> DataFrame:
    """By oversized item: pieces over the limit, that aren't the stretch they name, that overlap by more than allowed or leave a
    gap, and how far the pieces reach; the SQL says that there are no faults and that the whole text is covered."""
    w = Window.partitionBy("kind", "document_id", "item_no").orderBy("piece_no")
    size = F.length("text")
    before = F.coalesce(F.lag("char_end").over(w), F.lit(0))
    fault = (size > 2400) | (size != F.col("char_end") - F.col("char_start")) | (F.col("own_start") != before) | (F.col("own_start") - F.col("char_start") > 200) | (F.col("char_start") > F.col("own_start"))
    return p3_pieces(spark, folder).withColumn("_fault", fault).groupBy("kind", "document_id", "item_no").agg(F.count_if("_fault").cast("int").alias("n_faults"), F.max("char_end").alias("covered"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.repeated_line_occurrences(table(spark, folder, "extracted_documents"))


def p4_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without their hosts' repeated lines."""
    return site_lines.without_repeated_lines(table(spark, folder, "extracted_documents")).select("document_id", "host", "full_text").distinct()


_P4_LINES = """
WITH d AS (SELECT DISTINCT document_id, host, full_text FROM extracted_documents),
l AS (SELECT document_id, host, unnest(string_split(full_text, chr(10))) AS line, generate_subscripts(string_split(full_text, chr(10)), 1) - 1 AS line_no FROM d),
k AS (SELECT *, regexp_replace(lower(line), '[^\\p{L}]+', '', 'g') AS letters FROM l),
n AS (SELECT host, count(DISTINCT document_id) AS docs FROM extracted_documents GROUP BY host),
f AS (SELECT k.host, letters FROM k JOIN n ON k.host = n.host WHERE letters <> '' GROUP BY k.host, letters, docs
      HAVING count(DISTINCT document_id) >= 4 AND count(DISTINCT document_id) >= 0.05 * docs)"""

P4_FOUND_SQL = _P4_LINES + """
SELECT DISTINCT document_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN f ON k.host = f.host AND k.letters = f.letters"""

P4_CLEAN_SQL = _P4_LINES + """,
kept AS (SELECT k.document_id, line, line_no FROM k LEFT JOIN f ON k.host = f.host AND k.letters = f.letters WHERE f.letters IS NULL),
t AS (SELECT document_id, string_agg(line, chr(10) ORDER BY line_no) AS full_text FROM kept GROUP BY document_id)
SELECT d.document_id, d.host, CASE WHEN d.full_text IS NULL THEN NULL ELSE coalesce(t.full_text, '') END AS full_text FROM d LEFT JOIN t ON d.document_id = t.document_id"""


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return rank_fusion.undisputed_hits(table(spark, folder, "retrieved_chunks"))


def p6_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The whole leximin ranking of every question."""
    ranked = rank_fusion.leximin_ranking(table(spark, folder, "retrieved_chunks"))
    return ranked.select("question_id", "chunk_id", F.round(F.col("percentiles")[0], 9).alias("worst_percentile"), "final_rank")


_P6_RANKS = """
WITH h AS (SELECT DISTINCT question_id, chunk_id, CASE WHEN isnan(dense_distance) THEN NULL ELSE dense_distance END AS d,
             CASE WHEN isnan(sparse_score) THEN NULL ELSE sparse_score END AS s, CASE WHEN isnan(rrf_score) THEN NULL ELSE rrf_score END AS r FROM retrieved_chunks),
k AS (SELECT *, CASE WHEN d IS NOT NULL THEN rank() OVER (PARTITION BY question_id ORDER BY d NULLS LAST) END AS rd,
        CASE WHEN s IS NOT NULL THEN rank() OVER (PARTITION BY question_id ORDER BY s DESC NULLS LAST) END AS rs,
        CASE WHEN r IS NOT NULL THEN rank() OVER (PARTITION BY question_id ORDER BY r DESC NULLS LAST) END AS rr,
        count(*) OVER (PARTITION BY question_id) AS n FROM h)"""

P6_FOUND_SQL = _P6_RANKS + """
SELECT question_id, chunk_id FROM k AS a WHERE rd <= 3 AND rs <= 3 AND rr <= 3
AND NOT EXISTS (SELECT 1 FROM k AS b WHERE b.question_id = a.question_id AND b.chunk_id <> a.chunk_id AND b.rd <= 6 AND b.rs <= 6)"""

P6_RANKING_SQL = _P6_RANKS + """,
v AS (SELECT *, list_sort([coalesce(n - rd + 1, 0), coalesce(n - rs + 1, 0), coalesce(n - rr + 1, 0)]) AS v FROM k)
SELECT question_id, chunk_id, round(v[1] / n, 9) AS worst_percentile,
  row_number() OVER (PARTITION BY question_id ORDER BY v[1] DESC, v[2] DESC, v[3] DESC, chunk_id) AS final_rank FROM v"""


def _texts(spark: SparkSession, folder: str) -> list[tuple[DataFrame, str, str, str, str]]:
    return [(table(spark, folder, "extracted_documents"), "document", "document_id", "document_id", "full_text"), (table(spark, folder, "chunks"), "chunk", "chunk_id", "document_id", "text")]


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similar_pairs(_texts(spark, folder))


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record: its class of copies, its group of near-duplicates and its links."""
    return near_duplicates.groups(_texts(spark, folder))


#: All pairs by their shared shingles.
P7_FOUND_SQL = """
WITH r AS (SELECT DISTINCT 'document' AS kind, document_id AS id, document_id AS doc, full_text AS t FROM extracted_documents WHERE full_text IS NOT NULL
           UNION ALL SELECT DISTINCT 'chunk', chunk_id, document_id, text FROM chunks WHERE text IS NOT NULL),
l AS (SELECT kind, id, doc, lower(t) AS t FROM r WHERE len(list_filter(regexp_split_to_array(t, '[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+'), lambda x: x <> '')) >= 50),
w AS (SELECT kind, id, doc, regexp_extract_all(t, '[\\p{L}\\p{N}]+') AS w FROM l),
s AS (SELECT DISTINCT kind, id, doc, hash(unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w),
n AS (SELECT kind, id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.kind, a.id AS id_a, b.id AS id_b, count(*) AS c FROM s AS a JOIN s AS b ON a.kind = b.kind AND a.g = b.g AND a.id < b.id AND a.doc <> b.doc GROUP BY ALL)
SELECT p.kind, id_a, id_b FROM p JOIN n AS x ON p.kind = x.kind AND id_a = x.id JOIN n AS y ON p.kind = y.kind AND id_b = y.id WHERE c >= 0.6 * (x.n + y.n - c)"""


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, folder, "documents"))


def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Hash of each document's text as it comes back from its ids."""
    decoded = encoding.decode_corpus(encoding.encode_corpus(table(spark, folder, "documents")))
    return decoded.select("doc_id", F.sha2("text", 256).alias("text_sha256"))


P8_ROUNDTRIP_SQL = "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents"


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target share, share reached and repeats of every target source."""
    return mixing.mixed(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix, with how often each one stands in it."""
    return mixing.mixed(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


P9_CHECKS_SQL = """
WITH t AS (SELECT lower(trim(source)) AS source, max(target_share) AS share FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
d AS (SELECT DISTINCT lower(trim(source)) AS source FROM documents WHERE text <> '')
SELECT t.source, false AS over_cap, round(CASE WHEN d.source IS NULL THEN 0 ELSE share / sum(share) FILTER (d.source IS NOT NULL) OVER () END, 6) AS share_sought, true AS near FROM t LEFT JOIN d ON t.source = d.source"""


def p9_checks(spark: SparkSession, folder: str) -> DataFrame:
    """By target source: whether a document stands in the mix more often than allowed, the share sought, and whether the share
    reached lies within a document's weight of it; the SQL says what must come out."""
    documents, targets = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    mix, report = mixing.mixed(documents, targets)
    longest = mixing.mix_plan(documents, targets)[0].groupBy(F.col("_source").alias("source")).agg(F.max("_tokens").alias("_longest"))  # of those left out too
    most = mix.groupBy("source").agg(F.max("copies").alias("_most")).join(longest, "source", "full")
    total = F.sum("mixed_tokens").over(Window.partitionBy())  # one row a target
    near = F.abs(F.col("share_reached") - F.col("share_sought")) <= 2 * F.coalesce("_longest", F.lit(0)) / total + 1e-3
    return report.join(most, "source", "left").select(
        "source", (F.coalesce("_most", F.lit(0)) > F.col("max_repeats")).alias("over_cap"), F.round("share_sought", 6).alias("share_sought"), near.alias("near"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.document_subjects(table(spark, folder, "documents"), table(spark, folder, "subject_labels")).select("doc_id", "subject")


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by subject."""
    return subjects.composition(table(spark, folder, "documents"), table(spark, folder, "subject_labels"))


def p10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement with labels kept out of the learning (a report over the bounded sample)."""
    return subjects.agreement(spark, table(spark, folder, "documents"), table(spark, folder, "subject_labels"))


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_kept": p1_kept, "ingest_states": ingest_states, "p2_found": p2_found, "p2_bodies": p2_bodies, "p2_quality": p2_quality, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_checks": p3_checks, "p4_found": p4_found, "p4_clean": p4_clean, "p6_found": p6_found, "p6_ranking": p6_ranking,
            "p7_found": p7_found, "p7_groups": p7_groups, "p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p9_report": p9_report, "p9_mix": p9_mix, "p9_checks": p9_checks, "p10_found": p10_found, "p10_composition": p10_composition, "p10_quality": p10_quality}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_FOUND_SQL, "p3_checks": P3_CHECKS_SQL, "p4_found": P4_FOUND_SQL, "p4_clean": P4_CLEAN_SQL, "p6_found": P6_FOUND_SQL, "p6_ranking": P6_RANKING_SQL, "p7_found": P7_FOUND_SQL, "p9_checks": P9_CHECKS_SQL, "p8_roundtrip": P8_ROUNDTRIP_SQL}
