"""Links of pages, the link graph, and the crawl frontier over it."""

from __future__ import annotations

import functools
from html.parser import HTMLParser
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.arrow import map_columns
from corpusmill.functions.html import decoded
from corpusmill.functions.urls import host, is_crawlable, is_navigational, normalize_url
from corpusmill.session import cut


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self.found += [v for k, v in attrs if k == "href" and v]


def hrefs(page: str) -> list[str]:
    """Targets of a page's anchors in document order, entities resolved."""
    parser = _Anchors()
    parser.feed(page)
    return parser.found


def _resolved(base: str | None, href: str) -> str | None:
    try:
        return urljoin(base or "", href.strip())
    except ValueError:
        return None


def extract_links(pages: DataFrame, allowed: list[str], key: str = "fetch_id", base: str = "final_url", body: str = "body", content_type: str = "content_type") -> DataFrame:
    """key, position, link: canonical crawlable links of each HTML page, first mention only, in order."""
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}[key]

    def run(keys: list, bases: list, types: list, bodies: list) -> tuple:
        rows = []
        for k, at, t, b in zip(keys, bases, types, bodies):
            for i, h in enumerate(hrefs(decoded(b, t))):
                if (link := _resolved(at, h)) is not None:
                    rows.append((k, i, h, link))
        return tuple(map(list, zip(*rows))) if rows else ([], [], [], [])

    own = pages.where(F.contains(F.lower(F.coalesce(content_type, F.lit("text/html"))), F.lit("text/html")) & F.col(body).isNotNull())
    own = own.select(F.col(key).alias("_key"), F.col(base).alias("_base"), F.col(content_type).alias("_type"), F.col(body).alias("_body"))
    found = map_columns(own, run, f"_key {kind}, position int, href string, raw string").where(is_navigational(F.col("href")))
    # a page names the same targets again and again: each is judged once
    targets = found.select("raw").distinct().withColumn("link", normalize_url(F.col("raw"), allowed)).where("link is not null")
    found = found.join(targets.where(is_crawlable(F.col("link"))), "raw")
    return found.groupBy(F.col("_key").alias(key), "link").agg(F.min("position").alias("position")).select(key, "position", "link")


def host_graph(links: DataFrame, source: str = "source_host", link: str = "link") -> DataFrame:
    """source_host, target_host, n_links."""
    return links.groupBy(F.col(source).alias("source_host"), host(F.col(link)).alias("target_host")).agg(F.count("*").alias("n_links"))


@functools.lru_cache(maxsize=1024)
def _parsed(rules: str) -> RobotFileParser:
    parser = RobotFileParser()
    parser.parse(rules.splitlines())
    return parser


def robots_allow(rules: str | None, agent: str, url: str) -> bool:
    """Whether a robots.txt text lets ``agent`` fetch ``url``; no text means the host couldn't be asked: denied. A text is
    parsed once."""
    return rules is not None and _parsed(rules).can_fetch(agent, url)


def robots_filter(frontier: DataFrame, robots: DataFrame, agent: str = "corpusmill") -> DataFrame:
    """``frontier`` (with host, url) with allowed, by the target host's own rules (host, rules)."""
    joined = frontier.join(robots.select("host", "rules"), "host", "left")
    names = frontier.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frontier.select(*names).schema)

    def run(*cols: list) -> tuple:
        urls, rules = cols[names.index("url")], cols[-1]
        return (*cols[:-1], [robots_allow(r, agent, u) for r, u in zip(rules, urls)])

    return map_columns(joined.select(*names, "rules"), run, f"{kinds}, allowed boolean")


def within_budget(frontier: DataFrame, max_pages: int, order: list[str]) -> DataFrame:
    """The first ``max_pages`` rows by ``order`` of distinct urls: the crawl's page budget (a limit that is the feature)."""
    once = frontier.groupBy("url").agg(*[F.min(c).alias(c) for c in order])
    return once.orderBy(*order, "url").limit(max_pages)


def crawl_frontier(seeds: DataFrame, links: DataFrame, max_pages: int | None = 5000, depth_cap: int = 4) -> DataFrame:
    """url, depth of the pages reached breadth first from ``seeds`` (url) over ``links`` (source_url, link); pages at
    depth ``depth_cap`` are reached and not mined. Each level is one join; visited pages leave by an anti join.
    ``max_pages`` None keeps every page reached."""
    seen = cut(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)))
    last = seen
    for depth in range(1, depth_cap + 1):
        found = links.join(last.select(F.col("url").alias("source_url")), "source_url", "left_semi").select(F.col("link").alias("url")).distinct()
        last = cut(found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return seen if max_pages is None else within_budget(seen, max_pages, ["depth"]).select("url", "depth")


def by_host(seeds: DataFrame, url: str = "url", allowed: list[str] | None = None) -> DataFrame:
    """host, urls, n_urls of distinct seeds, in canonical form where the ``allowed`` hosts are given; the list of a host
    is as long as its seeds."""
    named = F.col(url) if allowed is None else normalize_url(F.col(url), allowed)
    own = seeds.select(named.alias("url")).where("url is not null").distinct().withColumn("host", host(F.col("url")))
    return own.groupBy("host").agg(F.sort_array(F.collect_list("url")).alias("urls"), F.count("*").alias("n_urls"))


def queue_positions(frontier: DataFrame) -> DataFrame:
    """``frontier`` (host, url, depth) with its place in the host's queue, by depth and url."""
    return frontier.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy("depth", "url")))
