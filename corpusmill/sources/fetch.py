"""Fetched pages: from a table, or by a fetcher that the caller gives (nothing here opens a connection)."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.config import DEFAULTS, Settings
from corpusmill.functions.arrow import columns, map_columns
from corpusmill.functions.urls import host, is_crawlable, normalize_url
from corpusmill.operators.links import extract_links, queue_positions, robots_allow, robots_filter
from corpusmill.session import cut

#: (url, request headers) → (status, headers in lower case, body).
Fetcher = Callable[[str, dict[str, str]], tuple[int, dict[str, str], bytes]]
REDIRECTS = (301, 302, 303, 307, 308)
FETCHED = "url string, final_url string, http_status int, content_type string, etag string, last_modified string, body binary, content_hash string, reason string"


def fetch_one(url: str, fetcher: Fetcher, admitted: Callable[[str], bool], content_types: tuple[str, ...] = ("text/html", "application/pdf"), hops: int = 5, headers: dict[str, str] | None = None, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One GET with its redirects: each hop must be admitted before it is requested; one retry after a second where the
    fetcher raises ``ConnectionError``; a body of another type is dropped; status 0 means that nothing was fetched."""
    here = url
    none = {"http_status": 0, "content_type": None, "etag": None, "last_modified": None, "body": None}
    for _ in range(hops + 1):
        for attempt in (0, 1):
            try:
                status, got, body = fetcher(here, headers or {})
                break
            except ConnectionError:
                if attempt:
                    return {**none, "final_url": here, "reason": "connection failed"}
                sleep(1.0)
            except TimeoutError:
                return {**none, "final_url": here, "reason": "timeout"}
        if status in REDIRECTS and got.get("location"):
            target = urljoin(here, got["location"])
            if not admitted(target):
                return {**none, "final_url": target, "reason": "redirect not admitted"}
            here = target
            continue
        kind = got.get("content-type", "")
        kept = None if status == 304 else body if any(t in kind.lower() for t in content_types) else b""
        return {"final_url": here, "http_status": status, "content_type": kind or None, "etag": got.get("etag"), "last_modified": got.get("last-modified"), "body": kept, "reason": "not modified" if status == 304 else None}
    return {**none, "final_url": here, "reason": "too many redirects"}


def fetch_pages(frontier: DataFrame, fetcher: Fetcher, admitted: Callable[[str], bool], known: DataFrame | None = None, delay_s: float = 0.0, content_types: tuple[str, ...] = DEFAULTS.content_types, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """url, final_url, http_status, content_type, etag, last_modified, body, content_hash, reason of each url of
    ``frontier`` (url, and place for the order within a host).

    A host's urls are fetched one after the other in one task, ``delay_s`` apart. ``known`` (url, etag, last_modified,
    content_hash): what a page was when it was fetched last; it is asked for only if it has changed, and one that hasn't
    (304) keeps its hash.
    """
    order = "place" if "place" in frontier.columns else "url"
    own = frontier.where("url is not null").groupBy("url").agg(F.min(order).cast("string" if order == "url" else "bigint").alias("_place"))
    past = ("etag", "last_modified", "content_hash")
    if known is None:
        own = own.select("url", "_place", *[F.lit(None).cast("string").alias(f"_{c}") for c in past])
    else:
        own = own.join(known.groupBy("url").agg(F.max(F.struct(*past)).alias("_k")), "url", "left").select("url", "_place", *[F.col(f"_k.{c}").alias(f"_{c}") for c in past])
    placed = own.withColumn("_host", host(F.col("url"))).repartition("_host").sortWithinPartitions("_host", "_place", "url")

    def run(urls: list, etags: list, modified: list, hashes: list) -> tuple:
        rows, last = [], {}
        for u, etag, since, digest in zip(urls, etags, modified, hashes):
            at = urlsplit(u).netloc
            if at in last and delay_s > 0:
                sleep(max(0.0, delay_s - (time.monotonic() - last[at])))
            headers = {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", since)) if v}
            got = fetch_one(u, fetcher, admitted, content_types, headers=headers, sleep=sleep)
            last[at] = time.monotonic()
            if got["http_status"] == 304:
                got = {**got, "etag": got["etag"] or etag, "last_modified": got["last_modified"] or since}
                found = digest
            else:
                found = hashlib.sha256(got["body"]).hexdigest() if got["body"] is not None else None
            rows.append((u, *(got[k] for k in ("final_url", "http_status", "content_type", "etag", "last_modified", "body")), found, got["reason"]))
        return columns(rows, 9)

    return map_columns(placed.select("url", *[f"_{c}" for c in past]), run, FETCHED)


def robots_of(hosts: DataFrame, fetcher: Fetcher) -> DataFrame:
    """host, rules of each host: the text of its robots.txt, '' if it has none (4xx), null if it can't be asked."""

    def run(names: list) -> tuple:
        out = []
        for name in names:
            got = fetch_one(f"https://{name}/robots.txt", fetcher, lambda u: True, ("",))
            status = got["http_status"]
            out.append((got["body"] or b"").decode("utf-8", "replace") if status == 200 else "" if 400 <= status < 500 else None)
        return names, out

    return map_columns(hosts.select("host").where("host is not null").distinct().repartition("host"), run, "host string, rules string")


def crawl(seeds: DataFrame, fetcher: Fetcher, settings: Settings = DEFAULTS, known: DataFrame | None = None, delay_s: float = 1.0, agent: str = "corpusmill", sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """All fetches of a crawl from ``seeds`` (url): url, depth, status ('success', 'skip', 'error'), and ``fetch_pages``' columns.

    Breadth first by depth up to ``settings.depth_cap``; pages at that depth are fetched and not mined. A url is queued
    once, in canonical form, if its host is allowed and its own host's robots.txt (read once a host) lets it; those that
    it doesn't let are kept as 'skip'. Hosts are queues in order of discovery that share one budget of
    ``settings.max_pages`` fetches: the budget is spread over the hosts by place in the queue.
    """
    spark, allowed = seeds.sparkSession, list(settings.allowed_hosts)
    robots = cut(robots_of(spark.createDataFrame([(h,) for h in allowed], "host string"), fetcher))
    rules = {r.host: r.rules for r in robots.collect()}  # one row an allowed host

    def admitted(target: str) -> bool:
        parts = urlsplit(target)
        return parts.scheme in ("http", "https") and parts.hostname in allowed and robots_allow(rules.get(parts.hostname), agent, target)

    found = seeds.select(normalize_url(F.col("url"), allowed).alias("url")).where("url is not null").distinct()
    seen, done, left, depth = None, None, settings.max_pages, 0
    while depth <= settings.depth_cap and left > 0:
        fresh = cut(found if seen is None else found.join(seen, "url", "left_anti"))
        if fresh.isEmpty():
            break
        seen = fresh if seen is None else seen.unionByName(fresh)
        named = fresh.withColumn("host", host(F.col("url")))
        gated = cut(robots_filter(named, robots, agent))
        queued = queue_positions(gated.where("allowed").withColumn("depth", F.lit(depth)))
        turn = cut(queued.orderBy("place", "url").limit(left).select("url", "place"))
        got = cut(fetch_pages(turn, fetcher, admitted, known, delay_s, settings.content_types, sleep).withColumn("depth", F.lit(depth)))
        left -= got.count()
        status = F.when(F.col("reason") == "redirect not admitted", "skip").when(F.col("http_status").isin(200, 304), "success").otherwise("error")
        denied = gated.where("not allowed").select("url", F.lit("robots.txt disallows").alias("reason"), F.lit("skip").alias("status"), F.lit(depth).alias("depth"))
        level = got.withColumn("status", status).unionByName(denied, allowMissingColumns=True)
        done = level if done is None else done.unionByName(level)
        pages = got.where("http_status = 200 and octet_length(body) > 0")
        found = extract_links(pages, allowed, key="url").select(F.col("link").alias("url")).where(is_crawlable(F.col("link"))).distinct()
        depth += 1
    empty = spark.createDataFrame([], FETCHED + ", depth int, status string")
    return empty if done is None else done.select(empty.columns)
