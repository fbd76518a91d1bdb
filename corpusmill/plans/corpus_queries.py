"""Queries and SQL over crawled pages, documents, chunks, logs and reports."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import redaction, urls
from corpusmill.operators import analytics, chunking, encode, extract, links, quality, snapshots
from corpusmill.plans.pipeline import ingest, run_ingest
from corpusmill.session import cut, scratch
from corpusmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: Areas of the test tables' sites that the queries allow. (Fixed values.)
AREAS = ("registrar", "students", "calendar", "advising", "coop", "wellness", "library", "athletics", "science", "law", "arts", "engineering", "residence", "finaid", "careers")
HOSTS = [f"{a}.northmere-u.example" for a in AREAS]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that must give the same."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_PARTS = r"'^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(?:#.*)?$'"
_part = lambda n: f"regexp_extract(u, {_PARTS}, {n})"
_HOST = f"lower(regexp_extract({_part(2)}, '^(?:[^@]*@)?([^:]*)', 1))"
_ALLOWED = "(" + ", ".join(f"'{h}'" for h in HOSTS) + ")"
_BARE = f"regexp_replace(regexp_replace({_part(3)}, ';[^/]*$', ''), '/index\\.html$', '/')"
_NORMAL = f"""CASE WHEN lower({_part(1)}) IN ('http', 'https', '') AND {_HOST} IN {_ALLOWED} THEN 'https://' || {_HOST} || regexp_extract({_part(2)}, '(:\\d+)$', 1)
  || CASE WHEN {_BARE} = '' THEN '/' ELSE {_BARE} END || CASE WHEN {_part(4)} = '?' THEN '' ELSE {_part(4)} END END"""
_URLS = "(SELECT DISTINCT u FROM (SELECT trim(url) AS u FROM crawl_results UNION ALL SELECT trim(final_url) FROM crawl_results UNION ALL SELECT trim(url) FROM documents) WHERE u IS NOT NULL)"
_DENIED = " OR ".join([f"starts_with(lower({_part(3)}), '{p}')" for p in urls.DENIED_PREFIXES] + [f"ends_with(lower({_part(3)}), '{s}')" for s in urls.DENIED_SUFFIXES])
_ERRORS = " OR ".join([f"contains(lower({_part(3)}), '{p}')" for p in urls.ERROR_PATHS] + [f"contains(lower({_part(4)}), '{urls.ERROR_QUERY}')"])


def _all_urls(spark: SparkSession, folder: str) -> DataFrame:
    crawls = table(spark, folder, "crawl_results")
    every = crawls.select(F.trim("url").alias("u")).unionAll(crawls.select(F.trim("final_url"))).unionAll(table(spark, folder, "documents").select(F.trim("url")))
    return every.where("u is not null").distinct()


@query(f"SELECT u AS url, {_NORMAL} AS canonical FROM {_URLS}")
def url_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return _all_urls(spark, folder).select(F.col("u").alias("url"), urls.normalize_url(F.col("u"), HOSTS).alias("canonical"))


@query(f"SELECT u AS url, lower({_part(1)}) IN ('http', 'https') AND NOT ({_DENIED}) AS crawlable, {_ERRORS} AS error_document, u <> '' AND NOT starts_with(u, '#') AND lower({_part(1)}) IN ('', 'http', 'https') AS navigational FROM {_URLS}")
def url_policy(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("u")
    return _all_urls(spark, folder).select(u.alias("url"), urls.is_crawlable(u).alias("crawlable"), urls.is_error_document(u).alias("error_document"), urls.is_navigational(u).alias("navigational"))


@query(f"SELECT host, count(*) AS n_fetches FROM crawl_results WHERE host IN {_ALLOWED} GROUP BY host")
def allowlist_semi(spark: SparkSession, folder: str) -> DataFrame:
    allowed = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    return table(spark, folder, "crawl_results").join(F.broadcast(allowed), "host", "left_semi").groupBy("host").agg(F.count("*").alias("n_fetches"))  # as many rows as HOSTS


@query("SELECT status, coalesce(reason, '') AS reason, count(*) AS n FROM crawl_results GROUP BY ALL")
def crawl_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "crawl_results").groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""SELECT DISTINCT fetch_id, CASE WHEN NOT coalesce({_HOST} IN {_ALLOWED}, false) THEN 'skip: redirected off allowlist' WHEN {_ERRORS} THEN 'skip: error document'
  WHEN http_status IN (200, 304) THEN 'success' ELSE 'error: HTTP ' || coalesce(http_status, 0) END AS outcome FROM (SELECT *, coalesce(final_url, url) AS u FROM crawl_results)""")
def classify_fetches(spark: SparkSession, folder: str) -> DataFrame:
    final = F.coalesce("final_url", "url")
    outcome = urls.classify_fetch(F.col("http_status"), urls.host(final).isin(*HOSTS), F.lit(True), final)
    return table(spark, folder, "crawl_results").select("fetch_id", outcome.alias("outcome")).distinct()


@query("""SELECT CASE WHEN contains(lower(content_type), 'application/pdf') THEN 'pdf' WHEN contains(lower(content_type), 'text/html') THEN 'html' END AS kind,
  coalesce(status = 'success' AND http_status = 200 AND octet_length(body) > 0 AND content_hash <> '', false) AS persistable, count(*) AS n FROM crawl_results GROUP BY ALL""")
def persistable_fetches(spark: SparkSession, folder: str) -> DataFrame:
    ok = F.coalesce((F.col("status") == "success") & urls.is_persistable(F.col("body"), F.col("content_hash"), F.col("http_status")), F.lit(False))
    return table(spark, folder, "crawl_results").groupBy(urls.content_kind(F.col("content_type")).alias("kind"), ok.alias("persistable")).agg(F.count("*").alias("n"))


@query(f"""SELECT regexp_extract(url, '^https://([^/:?#]*)', 1) AS host, list_sort(list(url)) AS urls, count(*) AS n_urls FROM (
  SELECT DISTINCT {_NORMAL} AS url FROM (SELECT trim(url) AS u FROM documents WHERE url IS NOT NULL)) WHERE url IS NOT NULL GROUP BY 1""")
def seeds_by_host(spark: SparkSession, folder: str) -> DataFrame:
    return links.by_host(table(spark, folder, "documents"), allowed=HOSTS)


@query("SELECT url, min(fetched_at) AS fetched_at FROM crawl_results WHERE url IS NOT NULL GROUP BY url ORDER BY fetched_at, url LIMIT 5000")
def crawl_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The first 5,000 distinct urls: the page budget is the feature."""
    return links.within_budget(table(spark, folder, "crawl_results").where("url is not null"), 5000, ["fetched_at"])


def _links(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "crawl_results").where("body is not null").groupBy("fetch_id").agg(F.max_by(F.struct("url", "final_url", "host", "content_type", "body"), F.xxhash64("url", "final_url", "content_type", "body")).alias("p")).select("fetch_id", "p.*")
    pages = pages.withColumn("base", F.coalesce("final_url", "url"))
    found = links.extract_links(pages, HOSTS, base="base")
    return found.join(pages.select("fetch_id", F.col("url").alias("source_url"), F.col("host").alias("source_host")), "fetch_id")


_LINKS_SQL = f"""
WITH p AS (SELECT DISTINCT ON (fetch_id) fetch_id, url, host, coalesce(final_url, url) AS base, replace(CAST(body AS VARCHAR), '\\x22', '"') AS page FROM crawl_results WHERE body IS NOT NULL AND contains(lower(coalesce(content_type, 'text/html')), 'text/html')),
h AS (SELECT fetch_id, url, host, base, unnest(regexp_extract_all(page, '<a [^>]*href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(page, '<a [^>]*href="([^"]*)"', 1), 1) - 1 AS position FROM p),
a AS (SELECT fetch_id, url AS source_url, host AS source_host, position, regexp_extract(base, '^(https?://[^/?#]*)', 1) || href AS u FROM h WHERE starts_with(href, '/') AND NOT starts_with(href, '//')),
n AS (SELECT fetch_id, source_url, source_host, position, {_NORMAL} AS link FROM a),
l AS (SELECT fetch_id, source_url, source_host, link, min(position) AS position FROM (SELECT *, link AS u FROM n WHERE link IS NOT NULL) WHERE NOT ({_DENIED}) GROUP BY ALL)"""


@query(_LINKS_SQL + " SELECT fetch_id, CAST(position AS INTEGER) AS position, link FROM l")
def extract_links(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder).select("fetch_id", "position", "link")


@query(_LINKS_SQL + " SELECT source_host, regexp_extract(link, '^https://([^/:?#]*)', 1) AS target_host, count(*) AS n_links FROM l GROUP BY ALL")
def link_host_graph(spark: SparkSession, folder: str) -> DataFrame:
    return links.host_graph(_links(spark, folder))


@query(_LINKS_SQL.replace("WITH p AS", "WITH RECURSIVE p AS") + f""",
g AS (SELECT DISTINCT source, link FROM (SELECT {_NORMAL} AS source, link FROM (SELECT source_url AS u, link FROM l)) WHERE source IS NOT NULL),
s AS (SELECT DISTINCT {_NORMAL} AS url FROM (SELECT url AS u FROM extracted_documents)),
r AS (SELECT url, 0 AS depth FROM s WHERE url IS NOT NULL UNION SELECT g.link, r.depth + 1 FROM r JOIN g ON g.source = r.url WHERE r.depth < 4)
SELECT url, min(depth) AS depth FROM r GROUP BY url""")
def crawl_frontier(spark: SparkSession, folder: str) -> DataFrame:
    """Every page reached from the documents' urls, with its depth. Seeds and sources are canonical as links are, so they
    meet; hosts that aren't allowed are never entered. The page budget has its own query."""
    found = cut(_links(spark, folder).select(urls.normalize_url(F.col("source_url"), HOSTS).alias("source_url"), "link").where("source_url is not null").distinct())
    seeds = table(spark, folder, "extracted_documents").select(urls.normalize_url(F.col("url"), HOSTS).alias("url"))
    return links.crawl_frontier(seeds, found, max_pages=None)


@query("SELECT coalesce(sha256(body) = lower(content_hash), false) AS hash_matches, count(*) AS n FROM crawl_results WHERE body IS NOT NULL GROUP BY ALL")
def content_hash_check(spark: SparkSession, folder: str) -> DataFrame:
    matches = F.coalesce(F.sha2("body", 256) == F.lower("content_hash"), F.lit(False))
    return table(spark, folder, "crawl_results").where("body is not null").groupBy(matches.alias("hash_matches")).agg(F.count("*").alias("n"))


@query("SELECT lower(content_hash) AS content_hash, min(url) AS canonical_url, count(DISTINCT url) AS n_urls FROM crawl_results WHERE content_hash IS NOT NULL AND url IS NOT NULL GROUP BY 1")
def content_hash_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "crawl_results").where("content_hash is not null and url is not null").groupBy(F.lower("content_hash").alias("content_hash"), "url").count()
    return own.groupBy("content_hash").agg(F.min("url").alias("canonical_url"), F.count("*").alias("n_urls"))


@query()
def page_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and headed sections of all kept pages."""
    pages = table(spark, folder, "crawl_results").where("body is not null").dropDuplicates(["fetch_id"]).withColumn("content_type", F.coalesce("content_type", F.lit("text/html")))
    got = extract.extract_pages(pages).select("fetch_id", "title", F.posexplode_outer("blocks").alias("block_no", "b"))
    return got.select("fetch_id", "title", "block_no", "b.heading_path", "b.anchor_id", "b.char_start", "b.char_end", "b.text")


_TOKENS = r"len(regexp_extract_all(full_text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))"
_HITS = " + ".join(f"CAST(contains(lower(full_text), '{p}') AS INT)" for p in quality.CONSENT_PHRASES)


@query(f"""SELECT DISTINCT document_id, coalesce({_TOKENS}, 0) AS n_tokens, coalesce({_HITS}, 0) AS phrase_hits,
  coalesce(trim(full_text) <> '' AND {_TOKENS} >= 80 AND ({_HITS}) = 0, false) AS usable FROM extracted_documents""")
def quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("full_text")
    return table(spark, folder, "extracted_documents").select("document_id", quality.token_count(t).alias("n_tokens"), quality.boilerplate_hits(t).alias("phrase_hits"), quality.is_usable(t).alias("usable")).distinct()


_LAST_EMBED = "SELECT document_id, lower(content_hash) AS hash FROM embed_results WHERE skipped = false AND finished_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY finished_at DESC, run_id DESC, lower(content_hash) DESC NULLS LAST) = 1"
_LATEST = "SELECT url, lower(content_hash) AS content_hash, fetched_at FROM crawl_results WHERE status = 'success' AND http_status = 200 AND body_bytes > 0 AND coalesce(content_hash, '') <> '' AND url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, fetch_id DESC, lower(content_hash) DESC) = 1"


@query(f"SELECT DISTINCT d.document_id FROM extracted_documents AS d JOIN ({_LAST_EMBED}) AS e ON d.document_id = e.document_id WHERE lower(d.content_hash) = e.hash")
def skip_unchanged(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.unchanged(table(spark, folder, "extracted_documents"), table(spark, folder, "embed_results"))


@query(f"""WITH o AS (SELECT DISTINCT url, content_hash, fetched_at, is_active FROM extracted_documents WHERE url IS NOT NULL), n AS ({_LATEST})
SELECT coalesce(o.url, n.url) AS url, CASE WHEN n.url IS NOT NULL THEN n.content_hash ELSE o.content_hash END AS content_hash, CASE WHEN n.url IS NOT NULL THEN n.fetched_at ELSE o.fetched_at END AS fetched_at,
  coalesce(is_active, true) AS is_active, CASE WHEN o.url IS NULL THEN 'inserted' WHEN n.url IS NULL THEN 'kept' WHEN lower(o.content_hash) IS NOT DISTINCT FROM n.content_hash THEN 'refreshed' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.url = n.url""")
def upsert_documents(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.upsert_documents(table(spark, folder, "extracted_documents"), snapshots.latest_fetches(table(spark, folder, "crawl_results")))


@query(f"""WITH bad AS (SELECT document_id FROM extracted_documents WHERE NOT coalesce(trim(full_text) <> '' AND {_TOKENS} >= 80 AND ({_HITS}) = 0, false))
SELECT c.document_id, count(DISTINCT chunk_id) AS n_chunks FROM chunks AS c WHERE document_id NOT IN (SELECT document_id FROM bad) GROUP BY c.document_id""")
def deactivate_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks by document after those of documents that fail the gate are gone."""
    documents = table(spark, folder, "extracted_documents")
    _, chunks = snapshots.deactivate(documents.select("document_id", "is_active"), table(spark, folder, "chunks"), documents.where(~quality.is_usable(F.col("full_text"))))
    return chunks.groupBy("document_id").agg(F.count_distinct("chunk_id").alias("n_chunks"))


@query("""WITH s AS (SELECT document_id, count(DISTINCT block_no) AS n FROM extract_blocks GROUP BY document_id)
SELECT DISTINCT c.document_id, c.ordinal FROM chunks AS c JOIN s ON c.document_id = s.document_id WHERE c.ordinal >= s.n""")
def excess_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    """Stored ordinals beyond a document's number of blocks, as if each block had become one chunk."""
    sizes = table(spark, folder, "extract_blocks").groupBy("document_id").agg(F.count_distinct("block_no").alias("n_chunks"))
    return snapshots.excess_ordinals(table(spark, folder, "chunks"), sizes)


@query("SELECT DISTINCT document_id, 0 AS n_mismatch, 0 AS n_oversize, 0 AS n_gaps FROM extract_blocks WHERE document_id IS NOT NULL AND regexp_matches(text, '\\S')")
def chunk_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """By document: chunks that aren't the slice of the stored text that they name, chunks over the limit, and gaps between
    chunks that hold text. The SQL says that there are none, for each document with text in its blocks."""
    texts = table(spark, folder, "extracted_documents").select("document_id", "full_text").distinct()
    chunks = chunking.chunk_blocks(table(spark, folder, "extract_blocks")).join(texts, "document_id")
    slice_ = lambda a, b: F.substring(F.col("full_text"), a + 1, b - a)
    w = Window.partitionBy("document_id").orderBy("char_start", "char_end")
    before = F.coalesce(F.max("char_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = chunks.withColumn("_gap", slice_(before, F.col("char_start")))
    number = lambda c: F.count_if(c).cast("int")
    return marked.groupBy("document_id").agg(
        number(~slice_(F.col("char_start"), F.col("char_end")).eqNullSafe(F.col("text"))).alias("n_mismatch"), number(F.col("token_count") > 350).alias("n_oversize"), number(F.col("_gap").rlike(r"(?U)\S")).alias("n_gaps"))


@query()
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_blocks(table(spark, folder, "extract_blocks"))


@query("SELECT 0 AS n_moved_ids, 0 AS n_repeated_ids, 0 AS n_repeated_keys, count(DISTINCT (document_id, ordinal)) FILTER (document_id NOT IN (SELECT document_id FROM extract_blocks WHERE document_id IS NOT NULL)) AS n_untouched FROM chunks")
def replaced_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """After the replacement: ids that a stored key lost, ids and keys that stand there twice, and the chunks of documents that weren't touched."""
    stored, after = table(spark, folder, "chunks"), cut(replace_chunks(spark, folder).select("chunk_id", "document_id", "ordinal"))
    ids = stored.groupBy("document_id", "ordinal").agg(F.min("chunk_id").alias("_old"))
    moved = after.join(ids, ["document_id", "ordinal"]).where("chunk_id <> _old").agg(F.count("*").cast("int").alias("n_moved_ids"))
    twice = lambda c, name: after.groupBy(*c).count().agg(F.count_if(F.col("count") > 1).cast("int").alias(name))
    touched = table(spark, folder, "extract_blocks").select("document_id").distinct()
    untouched = after.join(touched, "document_id", "left_anti").agg(F.count("*").alias("n_untouched"))
    return moved.join(twice(["chunk_id"], "n_repeated_ids"), F.lit(True)).join(twice(["document_id", "ordinal"], "n_repeated_keys"), F.lit(True)).join(untouched, F.lit(True))  # one row each


@query()
def replace_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk snapshot after every document with blocks was chunked again."""
    blocks, stored = table(spark, folder, "extract_blocks"), table(spark, folder, "chunks").dropDuplicates(["document_id", "ordinal"])
    return snapshots.replace_chunks(stored, chunking.chunk_blocks(blocks), blocks)


@query("SELECT DISTINCT chunk_id, CAST(CASE WHEN text IS NOT NULL THEN 64 END AS INTEGER) AS n_dims, CASE WHEN text IS NOT NULL THEN regexp_matches(text, '[\\p{L}\\p{N}]') END AS unit FROM chunks")
def embed_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Length of each chunk's vector, and whether its norm is 1 (0 for texts without words)."""
    got = embed_chunks(spark, folder)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return got.select("chunk_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("n_dims"), (F.abs(norm - 1) < 1e-4).alias("unit")).distinct()


@query()
def embed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return encode.embed(table(spark, folder, "chunks").select("chunk_id", "text").distinct()).select("chunk_id", "embedding")


@query("SELECT count(*) AS n_chunks, count(*) FILTER (token_count > 510) AS n_oversize FROM chunks")
def oversize_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return encode.oversize(table(spark, folder, "chunks"))


def newest_and_known(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The newest kept page of every url, and what is embedded of each."""
    pages = table(spark, folder, "crawl_results").where("status = 'success' and body is not null").withColumn("content_type", F.coalesce("content_type", F.lit("text/html")))
    newest = pages.groupBy("url").agg(F.max_by(F.struct("fetch_id", "fetched_at", "content_hash", "content_type", "body"), F.struct("fetched_at", "fetch_id")).alias("p")).where("url is not null").select("url", "p.*")
    known = table(spark, folder, "extracted_documents").select("document_id", "url").distinct().join(snapshots.embedded_state(table(spark, folder, "embed_results")), "document_id")
    return newest, known.select("url", "embedded_hash")


_NEWEST = "SELECT * FROM (SELECT url, lower(content_hash) AS content_hash, octet_length(body) AS n FROM crawl_results WHERE status = 'success' AND body IS NOT NULL AND url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, fetch_id DESC) = 1) WHERE content_hash IS NOT NULL AND n > 0"


@query(f"""WITH n AS ({_NEWEST}), k AS (SELECT url, max(hash) AS hash FROM (SELECT DISTINCT document_id, url FROM extracted_documents) JOIN ({_LAST_EMBED}) USING (document_id) GROUP BY url)
SELECT n.url, n.content_hash, coalesce(n.content_hash = k.hash, false) AS unchanged FROM n LEFT JOIN k ON n.url = k.url""")
def ingest_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that the pipeline saw, with the hash that it took and whether it could be left as it is."""
    done = ingest(*newest_and_known(spark, folder)).documents
    return done.select("url", F.lower("content_hash").alias("content_hash"), (F.col("state") == "unchanged").alias("unchanged"))


@query("SELECT 0 AS n_repeated_keys, 0 AS n_oversize, 0 AS n_without_vector, 0 AS n_gaps_in_ordinals")
def ingest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Faults in the chunks of the pipeline: keys that stand there twice, chunks over the limit or without a vector, documents whose ordinals don't run from 0."""
    per = ingest(*newest_and_known(spark, folder)).chunks.groupBy("url", "ordinal").agg(F.count("*").alias("n"), F.max("token_count").alias("tokens"), F.count("embedding").alias("vectors"))
    per = per.groupBy("url").agg(F.count_if(F.col("n") > 1).alias("a"), F.count_if(F.col("tokens") > 350).alias("b"), F.count_if(F.col("vectors") < F.col("n")).alias("c"), (F.max("ordinal") + 1 - F.count("*")).alias("d"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("int").alias(name)
    return per.agg(total("a", "n_repeated_keys"), total("b", "n_oversize"), total("c", "n_without_vector"), total("d", "n_gaps_in_ordinals"))


@query(f"WITH n AS ({_NEWEST}) SELECT count(*) AS n_documents, count(*) AS n_unchanged_again, 0 AS n_documents_lost, 0 AS n_chunks_lost FROM n")
def ingest_twice(spark: SparkSession, folder: str) -> DataFrame:
    """A run over all pages into an empty store, and the same run again: everything is unchanged then."""
    pages, _ = newest_and_known(spark, folder)
    store = scratch(spark, "ingest")
    one, two = run_ingest(spark, store, pages), run_ingest(spark, store, pages)
    lost = lambda a, b, key, name: a.select(key).join(b.select(key), key, "left_anti").agg(F.count("*").cast("int").alias(name))
    counts = two.summary.agg(F.sum("n_documents").alias("n_documents"), F.coalesce(F.sum(F.when(F.col("state") == "unchanged", F.col("n_documents"))), F.lit(0)).alias("n_unchanged_again"))
    return counts.join(lost(one.documents, two.documents, "document_id", "n_documents_lost"), F.lit(True)).join(lost(one.chunks, two.chunks, "chunk_id", "n_chunks_lost"), F.lit(True))  # one row each


@query()
def ingest_states(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by state after all kept pages went through the pipeline; `llm.queries` has the one that leaves residue out."""
    return ingest(*newest_and_known(spark, folder)).summary


#: Texts with identifiers in other scripts, so that the queries and their SQL are held to them too.
PLANTED = ("Write to josé@uni.example, jürgen.müller@uni.example or anna_b@unì.example.", "Numéro 123456789é and 123456789; é416-555-0199, 416-555-0199.", "Нина: нина@почта.example, K7L 3N6, éK7L 3N6.", "__é__ a_é@b.example _é_")


def _word_bounds(column: str) -> str:
    """RE2's word bounds know ASCII only: letters and digits of other scripts are put between underscores, which it takes
    for letters, and real underscores are doubled, so that ``_plain`` can undo it."""
    return f"regexp_replace(replace({column}, '_', '__'), '([^\\x00-\\x7F\\p{{M}}\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{C}}])', '_\\1_', 'g')"


def _re2(pattern: str) -> str:
    """Classes of all scripts for RE2."""
    out, inside = [], False
    for part in re.findall(r"\\.|.", pattern):
        inside = part == "[" or inside and part != "]"
        classes = {r"\w": r"\p{L}\p{N}_", r"\d": r"\p{Nd}"}
        out.append((classes[part] if inside else f"[{classes[part]}]") if part in classes else part)
    return "".join(out)


def _masked_sql(column: str, labels: int) -> str:
    for label, p in redaction.PATTERNS[:labels]:
        column = f"regexp_replace({column}, '{_re2(p)}', '⟨{label}⟩', 'g')"
    return column


def _plain(column: str) -> str:
    return f"replace(regexp_replace({column}, '_([^\\x00-\\x7F])_', '\\1', 'g'), '__', '_')"


_PII_TEXTS = "(SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'chunk', chunk_id, text FROM chunks UNION ALL SELECT 'question', question_id, redacted_text FROM questions" + "".join(
    f" UNION ALL SELECT 'planted', {i}, '{t}'" for i, t in enumerate(PLANTED)) + ")"


def _pii_texts(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda t, kind, key, text: table(spark, folder, t).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(text).alias("text"))
    planted = spark.createDataFrame([("planted", i, t) for i, t in enumerate(PLANTED)], "kind string, id bigint, text string")
    return part("documents", "document", "doc_id", "text").unionAll(part("chunks", "chunk", "chunk_id", "text")).unionAll(part("questions", "question", "question_id", "redacted_text")).unionAll(planted)


_MARKED = f"(SELECT kind, id, {_word_bounds('text')} AS text FROM {_PII_TEXTS})"


@query("SELECT kind, id, " + ", ".join(f"coalesce(len(regexp_extract_all({_masked_sql('text', i)}, '{_re2(p)}')), 0) AS n_{label.lower()}" for i, (label, p) in enumerate(redaction.PATTERNS)) + f" FROM {_MARKED}")
def pii_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = redaction.counts(F.col("text"))
    return _pii_texts(spark, folder).select("kind", "id", *[c.alias(f"n_{label.lower()}") for label, c in found.items()])


@query(f"SELECT kind, id, sha256({_plain(_masked_sql('text', 4))}) AS masked_sha256 FROM {_MARKED}")
def pii_mask(spark: SparkSession, folder: str) -> DataFrame:
    return _pii_texts(spark, folder).select("kind", "id", F.sha2(redaction.mask(F.col("text")), 256).alias("masked_sha256"))


@query("SELECT doc_id, sha256(text) AS restored_sha256 FROM documents")
def pii_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    got = redaction.redact(table(spark, folder, "documents"), "doc_id", "text")
    return got.select("doc_id", F.sha2(redaction.restore(F.col("redacted"), F.col("placeholders")), 256).alias("restored_sha256"))


@query("SELECT max(fetched_at) AS last_fetched_at, count(DISTINCT document_id) FILTER (is_active) AS n_active FROM extracted_documents")
def kb_health(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "extracted_documents").agg(F.max("fetched_at").alias("last_fetched_at"), F.count_distinct(F.when(F.col("is_active"), F.col("document_id"))).alias("n_active"))


@query("""SELECT run_id, count(*) AS n_documents, CAST(sum(embedded) AS BIGINT) AS n_chunks, count(*) FILTER (skipped) AS n_unchanged, count(*) FILTER (finished_at IS NULL) AS n_cut_off
FROM (SELECT DISTINCT * FROM embed_results) GROUP BY run_id""")
def ingest_summary(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embed_results").distinct().groupBy("run_id").agg(
        F.count("*").alias("n_documents"), F.sum("embedded").alias("n_chunks"), F.count_if("skipped").alias("n_unchanged"), F.count_if(F.col("finished_at").isNull()).alias("n_cut_off"))


_TRENDS = """(SELECT *, round(size * (1 - mean_confidence * (1 - refusal_rate)), 4) AS priority FROM (
  SELECT CAST(date_trunc('week', asked_at) AS DATE) AS week_start, coalesce(topic_label, 'unknown') AS topic, count(*) AS size,
    round(coalesce(avg(CAST(retrieval_confidence AS DOUBLE)), 0), 6) AS mean_confidence, round(avg(CAST(was_refused AS DOUBLE)), 6) AS refusal_rate FROM questions GROUP BY ALL))"""


@query(f"SELECT * FROM {_TRENDS}")
def weekly_trends(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.weekly_trends(table(spark, folder, "questions"))


@query(f"SELECT *, row_number() OVER (PARTITION BY week_start ORDER BY priority DESC, topic) AS place FROM {_TRENDS} QUALIFY place <= 3")
def weekly_top_topics(spark: SparkSession, folder: str) -> DataFrame:
    """The three most pressing topics of each week (a report's limit)."""
    return analytics.ranked_clusters(analytics.weekly_trends(table(spark, folder, "questions")), 3)


@query("""WITH q AS (SELECT *, CAST(date_trunc('week', asked_at) AS DATE) AS week_start, coalesce(topic_label, 'unknown') AS label FROM questions)
SELECT week_start, label, count(*) AS size, round(coalesce(avg(CAST(retrieval_confidence AS DOUBLE)), 0), 6) AS mean_confidence, round(avg(CAST(was_refused AS DOUBLE)), 6) AS refusal_rate,
  list_sort(list(DISTINCT redacted_text))[1:3] AS sample_questions FROM q GROUP BY week_start, label""")
def cluster_stats(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.cluster_stats(table(spark, folder, "questions"))


@query("""SELECT CAST(date_trunc('week', asked_at) AS DATE) AS week_start, CASE WHEN topic_label = 'health' THEN 'wellbeing' ELSE coalesce(topic_label, 'unknown') END AS topic,
  count(*) AS size, count(DISTINCT question_id) AS n_units FROM questions GROUP BY 1, 2 HAVING n_units >= 5""")
def k_anonymous_report(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.k_anonymous(table(spark, folder, "questions"), unit="question_id", coarse={"health": analytics.COARSE_TOPIC})


@query("SELECT document_id, kind, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT document_id, '{k}' AS kind, unnest(regexp_extract_all(full_text, '{p}')) AS value FROM extracted_documents" for k, p in analytics.FACTS) + ") GROUP BY ALL")
def fact_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.fact_candidates(table(spark, folder, "extracted_documents"), "document_id", "full_text")


@query("""WITH f AS (SELECT document_id, kind, value FROM (""" + " UNION ALL ".join(f"SELECT document_id, '{k}' AS kind, unnest(regexp_extract_all(full_text, '{p}')) AS value FROM extracted_documents" for k, p in analytics.FACTS) + """)),
j AS (SELECT DISTINCT f.document_id, title, kind, value FROM f JOIN extracted_documents AS d ON f.document_id = d.document_id WHERE title IS NOT NULL)
SELECT title, kind, count(DISTINCT value) AS n_values, count(DISTINCT document_id) AS n_sources, list_sort(list(DISTINCT value)) AS values FROM j GROUP BY title, kind HAVING n_values > 1 AND n_sources > 1""")
def fact_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of one title that state different dates, amounts or deadlines."""
    pages = table(spark, folder, "extracted_documents")
    stated = analytics.fact_candidates(pages, "document_id", "full_text").join(pages.where("title is not null").select("document_id", "title").distinct(), "document_id")
    return analytics.conflicts(stated, ["title", "kind"], "value", "document_id")


@query("SELECT user_id, time_bucket(INTERVAL '10 minutes', ts) AS window_start, count(*) AS n_requests FROM events GROUP BY ALL HAVING count(*) > 1")
def rate_limit_windows(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.rate_limit_windows(table(spark, folder, "events"), most=1)


@query("""WITH r AS (SELECT DISTINCT question_id, coalesce(retrieval_confidence >= 0.5, false) AS correct, coalesce(retrieval_confidence < 0.35, true) AS should_refuse, was_refused, NOT had_conflict AS citations_valid,
  coalesce(CAST(retrieval_confidence AS DOUBLE), 0) AS latency_s FROM questions)
SELECT count(*) AS n, round(avg(CAST(correct AS INT)) FILTER (NOT should_refuse), 6) AS accuracy, round(avg(CAST(citations_valid AS INT)) FILTER (NOT was_refused), 6) AS citation_validity,
  round(avg(CAST(NOT correct AND NOT was_refused AS INT)), 6) AS wrong_answer_rate, round(avg(CAST(was_refused AS INT)) FILTER (should_refuse), 6) AS correct_refusal,
  round(avg(CAST(was_refused AS INT)) FILTER (NOT should_refuse), 6) AS false_refusal, round(quantile_cont(latency_s, 0.95), 6) AS p95_latency_s FROM r""")
def evaluation_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics over the question log, its confidence standing in for judgements and latency."""
    c = F.col("retrieval_confidence")
    own = table(spark, folder, "questions").select("question_id", F.coalesce(c >= 0.5, F.lit(False)).alias("correct"), F.coalesce(c < 0.35, F.lit(True)).alias("should_refuse"), "was_refused", (~F.col("had_conflict")).alias("citations_valid"), F.coalesce(c.cast("double"), F.lit(0.0)).alias("latency_s"))
    return analytics.evaluation(own.distinct())


@query("""SELECT *, len(cited) > 0 AND len(list_filter(cited, lambda n: n < 1 OR n > 4)) = 0 AS all_resolve FROM (
  SELECT question_id, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda n: CAST(n AS INT)))) AS cited FROM (
    SELECT DISTINCT question_id, 'See [' || question_id % 7 || ']. ' || redacted_text || ' Also [2].' AS answer FROM questions))""")
def citation_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Marks of answers made from the questions, four chunks each."""
    answer = F.concat(F.lit("See ["), (F.col("question_id") % 7).cast("string"), F.lit("]. "), "redacted_text", F.lit(" Also [2]."))
    made = table(spark, folder, "questions").select("question_id", answer.alias("answer"), F.lit(4).alias("n_chunks")).distinct()
    return analytics.citation_validity(made).select("question_id", F.array_sort("cited").alias("cited"), "all_resolve")


@query("SELECT DISTINCT question_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(redacted_text, '{p}') THEN '{a}' END" for a, p in analytics.SUPPORT_WORDS) + "], lambda x: x IS NOT NULL) AS areas FROM questions")
def support_areas(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "questions").select("question_id", analytics.support_areas(F.col("redacted_text")).alias("areas")).distinct()


@query()
def question_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of the questions by their vectors."""
    asked = table(spark, folder, "questions").select("question_id", F.trim("redacted_text").alias("text")).where("text <> ''").distinct()
    return analytics.question_clusters(encode.embed(asked, out="vector"), "question_id", "vector")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
