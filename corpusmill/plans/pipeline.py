"""The ingest pipeline: pages → sections → gate → chunks → vectors, only for what changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.config import DEFAULTS, Settings
from corpusmill.functions.arrow import columns, map_columns
from corpusmill.functions.fulltext import tsv
from corpusmill.operators.chunking import Tokenizer, chunk_document
from corpusmill.operators.encode import Encoder, embed, hashing_encoder
from corpusmill.operators.extract import PdfReader, extract_pages
from corpusmill.operators.incremental import MerkleStore
from corpusmill.operators.quality import is_usable
from corpusmill.operators.snapshots import document_id_of, replace_chunks
from corpusmill.session import cut, spread


@dataclass(frozen=True)
class Ingested:
    """documents: url, content_hash, state, title, error; chunks: url, content_hash, ordinal, …, embedding; summary: counts by state."""

    documents: DataFrame
    chunks: DataFrame
    summary: DataFrame


CHUNK = "ordinal int, text string, heading_path string, char_start int, char_end int, url_anchor string, token_count int, tsv map<string,array<int>>"


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row a url, its last fetch: by fetched_at and fetch_id where they are given, then by hash."""
    order = F.struct(*[c for c in ("fetched_at", "fetch_id") if c in pages.columns], F.lower("content_hash"), "content_type", F.xxhash64("body"))
    rest = [c for c in pages.columns if c != "url"]
    own = pages.where("url is not null and content_hash is not null and octet_length(body) > 0")
    return own.groupBy("url").agg(F.max_by(F.struct(*rest), order).alias("_p")).select("url", *[F.col(f"_p.{c}").alias(c) for c in rest])


def ingest(pages: DataFrame, embedded: DataFrame | None = None, encoder: Encoder = hashing_encoder, force: bool = False, settings: Settings = DEFAULTS, reader: PdfReader | None = None, excluded: DataFrame | None = None, tokenizer: Tokenizer | None = None) -> Ingested:
    """``pages``: url, content_hash, content_type, body of successful fetches (with fetched_at and fetch_id if a url may
    stand there more than once: its last fetch counts); ``embedded``: url, embedded_hash; ``excluded``: url, content_hash
    of pages that the caller leaves out (such as those with residue), whatever else holds; ``tokenizer`` counts tokens.

    States: 'excluded', 'unchanged' (before anything costly), 'extract_skipped', 'quality_rejected', 'error', 'ok'.
    A document that can't be read, chunked or encoded is an 'error' with its reason and without chunks; the others go on.
    """
    own = latest_pages(pages.select("url", "content_hash", "content_type", "body", *[c for c in ("fetched_at", "fetch_id") if c in pages.columns])).select("url", "content_hash", "content_type", "body")
    left_out = None
    if excluded is not None:
        marks = excluded.select("url", F.lower("content_hash").alias("_out")).distinct()
        by = (own["url"] == marks["url"]) & (F.lower(own["content_hash"]) == marks["_out"])
        left_out = own.join(marks, by, "left_semi").select("url", "content_hash")
        own = own.join(marks, by, "left_anti")
    if embedded is not None and not force:
        same = embedded.groupBy("url").agg(F.max(F.lower("embedded_hash")).alias("_hash"))
        joined = own.join(same, "url", "left").withColumn("_same", F.coalesce(F.lower("content_hash") == F.col("_hash"), F.lit(False)))
    else:
        joined = own.withColumn("_same", F.lit(False))
    todo = joined.where("not _same").select("url", F.struct("url", "content_hash").alias("_key"), "content_type", "body")
    got = cut(extract_pages(spread(todo, pages, "url"), "_key", reader=reader)).select("_key.*", "ok", "error", "title", "full_text", "blocks")
    state = F.when(F.col("error").isNotNull(), "error").when(~F.col("ok"), "extract_skipped").when(~is_usable(F.col("full_text"), settings.quality_floor_tokens), "quality_rejected").otherwise("ok")
    rated = got.withColumn("state", state)

    def chunk(urls: list, hashes: list, groups: list) -> tuple:
        rows = []
        for u, h, g in zip(urls, hashes, groups):
            try:
                rows += [(u, h, i, *c, list(tsv(c[0]).items()), None) for i, c in enumerate(chunk_document([(b["text"], b["heading_path"], b["anchor_id"], b["char_start"]) for b in g], settings, tokenizer))]
            except Exception as x:  # the row says so
                rows.append((u, h, *[None] * 8, f"{type(x).__name__}: {x}"))
        return columns(rows, 11)

    made = map_columns(rated.where("state = 'ok'").select("url", "content_hash", "blocks"), chunk, f"url string, content_hash string, {CHUNK}, failure string")
    made = cut(embed(made, encoder=encoder, batch=settings.encode_batch, error="_error").withColumn("failure", F.coalesce("failure", "_error")).drop("_error"))
    failed = made.where("failure is not null").groupBy("url").agg(F.min("failure").alias("_failure"))
    chunks = made.join(failed, "url", "left_anti").drop("failure")
    none = F.lit(None).cast("string")
    rated = rated.join(failed, "url", "left").withColumn("state", F.when(F.col("_failure").isNotNull(), "error").otherwise(F.col("state"))).withColumn("error", F.coalesce("error", "_failure"))
    documents = rated.select("url", "content_hash", "state", "title", "error").unionByName(joined.where("_same").select("url", "content_hash", F.lit("unchanged").alias("state"), none.alias("title"), none.alias("error")))
    if left_out is not None:
        documents = documents.unionByName(left_out.select("url", "content_hash", F.lit("excluded").alias("state"), none.alias("title"), none.alias("error")))
    return Ingested(documents, chunks, documents.groupBy("state").agg(F.count("*").alias("n_documents")))


@dataclass(frozen=True)
class Snapshot:
    """documents: document_id, url, title, content_type, content_hash, etag, http_status, fetched_at, is_active,
    embedded_hash; chunks: chunk_id, document_id, ordinal, …, embedding; summary: counts by state of the run."""

    documents: DataFrame
    chunks: DataFrame
    summary: DataFrame


def run_ingest(spark: SparkSession, folder: str, pages: DataFrame, encoder: Encoder = hashing_encoder, settings: Settings = DEFAULTS, reader: PdfReader | None = None, excluded: DataFrame | None = None, tokenizer: Tokenizer | None = None) -> Snapshot:
    """One run over all successful fetches (url, content_hash, content_type, body, fetched_at, and fetch_id, http_status
    and etag if there are any) into the store in ``folder``.

    The Merkle tree of the store names the urls whose hash is new or changed; only these are extracted, gated, chunked
    and encoded. Documents are upserted, rejected ones deactivated and their chunks dropped, chunks of processed ones
    replaced under their old ids, embedded_hash advanced. Documents, chunks and tree come into force in one rename, so a
    run that fails leaves the last state, and the same run again changes nothing. Failed documents are tried again in
    the next run.
    """
    store = MerkleStore(spark, folder)
    absent = {"etag": "string", "http_status": "int", "fetch_id": "bigint"}
    named = pages.select("url", "content_hash", "content_type", "body", "fetched_at", *[F.col(c).cast(t).alias(c) if c in pages.columns else F.lit(None).cast(t).alias(c) for c, t in absent.items()])
    latest = latest_pages(named).withColumn("content_hash", F.lower("content_hash"))
    changes = store.changes(latest, "url", "content_hash")
    todo = latest.join(changes.rows.where("change <> 'removed'").select(F.col("key").alias("url")), "url", "left_semi")
    done = ingest(todo, None, encoder, settings=settings, reader=reader, excluded=excluded, tokenizer=tokenizer)
    states = cut(done.documents)
    old_documents, old_chunks = store.output("documents"), store.output("chunks")
    new = latest.drop("body", "fetch_id").join(states.select("url", "state", F.col("title").alias("_title")), "url", "left")
    if old_documents is None:
        both = new.withColumns({"o_title": F.lit(None).cast("string"), "o_active": F.lit(None).cast("boolean"), "o_hash": F.lit(None).cast("string")})
        rest = None
    else:
        kept = old_documents.select("url", F.col("title").alias("o_title"), F.col("is_active").alias("o_active"), F.col("embedded_hash").alias("o_hash"))
        both, rest = new.join(kept, "url", "left"), old_documents.join(new.select("url"), "url", "left_anti")
    off = F.coalesce(F.col("state").isin("quality_rejected", "excluded"), F.lit(False))
    documents = both.select(
        document_id_of(F.col("url")).alias("document_id"), "url", F.coalesce("_title", "o_title").alias("title"), "content_type", "content_hash", "etag", "http_status", "fetched_at",
        F.when(off, False).when(F.col("state") == "ok", True).otherwise(F.coalesce("o_active", F.lit(True))).alias("is_active"),
        F.when(off, None).when(F.col("state") == "ok", F.col("content_hash")).otherwise(F.col("o_hash")).alias("embedded_hash"),
    )
    documents = documents if rest is None else documents.unionByName(rest)
    fresh = done.chunks.withColumn("document_id", document_id_of(F.col("url"))).drop("url", "content_hash")
    stored = old_chunks if old_chunks is not None else fresh.limit(0).withColumn("chunk_id", F.lit("").cast("string"))
    touched = states.where("state in ('ok', 'quality_rejected', 'excluded')").select(document_id_of(F.col("url")).alias("document_id"))
    chunks = replace_chunks(stored, fresh, touched)
    store.publish(changes, {"documents": documents, "chunks": chunks}, failed=states.where("state = 'error'").select(F.col("url").alias("key")))
    n_all = latest.select("url").join(states.select("url"), "url", "left_anti").select(F.lit("unchanged").alias("state")).unionByName(states.select("state"))
    return Snapshot(store.output("documents"), store.output("chunks"), n_all.groupBy("state").agg(F.count("*").alias("n_documents")))


def summary_text(summary: DataFrame) -> str:
    """The counters as six fixed lines under a banner; states without documents are 0."""
    found = {r.state: r.n_documents for r in summary.collect()}  # one row a state
    names = (("pages", None), ("embedded", "ok"), ("unchanged", "unchanged"), ("extract skipped", "extract_skipped"), ("quality rejected", "quality_rejected"), ("errors", "error"))
    return "\n".join(["Ingest summary", *(f"{label}: {sum(found.values()) if key is None else found.get(key, 0)}" for label, key in names)])
