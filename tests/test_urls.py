from pyspark.sql import functions as F

from corpusmill.functions import urls
from corpusmill.operators import links

ALLOWED = ["a.example", "b.example"]


def test_normalize_url(spark):
    cases = [
        ("https://a.example/x/", "https://a.example/x/"), ("http://A.Example/x/index.html#frag", "https://a.example/x/"), ("https://a.example:8443/x/index.html", "https://a.example:8443/x/"),
        ("https://a.example/foo/my-index.html", "https://a.example/foo/my-index.html"), ("https://a.example/index.php?q=1", "https://a.example/index.php?q=1"), ("https://a.example/x#y", "https://a.example/x"),
        ("https://a.example", "https://a.example/"), ("//b.example/p;v=1?x", "https://b.example/p?x"), ("mailto:x@a.example", None), ("tel:1", None), ("javascript:void(0)", None), ("ftp://a.example/x", None),
        ("https://other.example/", None), ("/relative", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame(cases, "url string, expected string").withColumn("got", urls.normalize_url(F.col("url"), ALLOWED))
    assert [(r.url, r.got) for r in df.collect()] == cases


def test_policy(spark):
    cases = [
        ("https://a.example/page", True, False), ("https://a.example/doc.pdf", True, False), ("https://a.example/style.CSS", False, False), ("https://a.example/_ato/x", False, False), ("https://a.example/x.js?page=1", False, False),
        ("https://a.example/404/404.html", False, True), ("https://a.example/error/x", True, True), ("https://a.example/p?prereq=1", True, True), ("mailto:x", False, False),
    ]
    df = spark.createDataFrame(cases, "url string, crawlable boolean, error boolean")
    got = df.select("url", urls.is_crawlable(F.col("url")), urls.is_error_document(F.col("url"))).collect()
    assert [tuple(r) for r in got] == cases


def test_persistable_and_classes(spark):
    df = spark.createDataFrame([(b"x", "h", 200), (b"", "h", 200), (None, "h", 200), (b"x", "", 200), (b"x", None, 200), (b"x", "h", 304), (b"x", "h", None)], "body binary, hash string, status int")
    assert [r[0] for r in df.select(urls.is_persistable(F.col("body"), F.col("hash"), F.col("status"))).collect()] == [True] + [False] * 6
    rows = [(200, True, True, "https://a.example/"), (404, True, True, "https://a.example/"), (200, False, True, "x"), (200, True, False, "x"), (200, True, True, "https://a.example/404.html"), (None, True, True, "x")]
    df = spark.createDataFrame(rows, "s int, h boolean, r boolean, u string")
    got = [r[0] for r in df.select(urls.classify_fetch(F.col("s"), F.col("h"), F.col("r"), F.col("u"))).collect()]
    assert got == ["success", "error: HTTP 404", "skip: redirected off allowlist", "skip: robots.txt disallows redirect target", "skip: error document", "error: HTTP 0"]


def test_links_in_order_once(spark):
    page = b"""<a href="https://a.example/one">1</a><a href="/two">2</a><a href="two/../three?x=1&amp;y=2">3</a><a HREF='//B.example/four#f'>4</a><a href="https://a.example/one#again">5</a>
    <a href="#top">6</a><a href="mailto:q@a.example">7</a><a href="javascript:x()">8</a><a href="https://elsewhere.example/">9</a><a href="/style.css">10</a>"""
    df = spark.createDataFrame([(1, "https://a.example/base/", "text/html", page), (2, None, "text/html", None), (3, "https://a.example/", "application/pdf", page)], "fetch_id long, final_url string, content_type string, body binary")
    got = links.extract_links(df, ALLOWED).orderBy("position").collect()
    assert [(r.fetch_id, r.link) for r in got] == [(1, "https://a.example/one"), (1, "https://a.example/two"), (1, "https://a.example/base/three?x=1&y=2"), (1, "https://b.example/four")]


def test_frontier_depth_and_budget(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "a")], "source_url string, link string")
    seeds = spark.createDataFrame([("a",), ("a",)], "url string")
    assert {tuple(r) for r in links.crawl_frontier(seeds, edges).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {r.url for r in links.crawl_frontier(seeds, edges, depth_cap=1).collect()} == {"a", "b", "c"}
    assert links.crawl_frontier(seeds, edges, max_pages=3).count() == 3


def test_frontier_query_keeps_every_page_reached(spark, tmp_path):
    from corpusmill.plans.corpus_queries import QUERIES

    at = "https://law.northmere-u.example"
    page = "".join(f"<a href='/p{i}'>x</a>" for i in range(5100)).encode()
    crawls = [(1, f"{at}/index.html", None, "law", "text/html", page), (2, f"{at}/p7", None, "law", None, b"<a href='/deep'>x</a>"), (3, f"{at}/island", None, "law", None, b"<a href='/never'>x</a>")]
    spark.createDataFrame(crawls, "fetch_id long, url string, final_url string, host string, content_type string, body binary").write.parquet(str(tmp_path / "crawl_results.parquet"))
    spark.createDataFrame([(f"{at}/",), (None,), ("https://elsewhere.example/",)], "url string").write.parquet(str(tmp_path / "extracted_documents.parquet"))
    got = {r.url: r.depth for r in QUERIES["crawl_frontier"](spark, str(tmp_path)).collect()}
    assert got == {f"{at}/": 0, **{f"{at}/p{i}": 1 for i in range(5100)}, f"{at}/deep": 2}


def test_robots_fail_closed(spark):
    frontier = spark.createDataFrame([("a", "https://a/x"), ("a", "https://a/private/x"), ("b", "https://b/x"), ("c", "https://c/x")], "host string, url string")
    robots = spark.createDataFrame([("a", "User-agent: *\nDisallow: /private/"), ("c", "<html>not found</html>")], "host string, rules string")
    assert {r.url: r.allowed for r in links.robots_filter(frontier, robots).collect()} == {"https://a/x": True, "https://a/private/x": False, "https://b/x": False, "https://c/x": True}


def test_fetch_redirects():
    from corpusmill.sources.fetch import fetch_one

    pages = {"https://a/1": (302, {"location": "/2"}, b""), "https://a/2": (200, {"content-type": "text/html"}, b"ok"), "https://a/out": (301, {"location": "https://z/"}, b""), "https://a/img": (200, {"content-type": "image/png"}, b"x"), "https://a/loop": (302, {"location": "/loop"}, b"")}
    asked = []

    def fetcher(url, headers):
        asked.append(url)
        return pages[url]

    admitted = lambda u: u.startswith("https://a/")
    assert fetch_one("https://a/1", fetcher, admitted)["final_url"] == "https://a/2"
    assert fetch_one("https://a/out", fetcher, admitted)["reason"] == "redirect not admitted" and "https://z/" not in asked
    assert fetch_one("https://a/img", fetcher, admitted)["body"] == b""
    assert fetch_one("https://a/loop", fetcher, admitted)["reason"] == "too many redirects"


def test_fetch_waits_and_asks_conditionally(spark):
    from corpusmill.sources.fetch import fetch_one, fetch_pages

    waits, tries = [], []

    def flaky(url, headers):
        tries.append(url)
        raise ConnectionError

    assert fetch_one("https://a/1", flaky, lambda u: True, sleep=waits.append)["reason"] == "connection failed" and waits == [1.0] and len(tries) == 2

    def server(url, headers):
        if headers.get("If-None-Match") == "e1":
            return 304, {}, b""
        return 200, {"content-type": "text/html", "etag": "e2"}, url.encode()

    known = spark.createDataFrame([("https://a/1", "e1", None, "old")], "url string, etag string, last_modified string, content_hash string")
    frontier = spark.createDataFrame([("https://a/1",), ("https://a/2",), ("https://a/2",), (None,)], "url string")
    got = {r.url: r for r in fetch_pages(frontier, server, lambda u: True, known).collect()}
    assert set(got) == {"https://a/1", "https://a/2"} and (got["https://a/1"].http_status, got["https://a/1"].content_hash, got["https://a/1"].etag, got["https://a/1"].body) == (304, "old", "e1", None)
    assert got["https://a/2"].etag == "e2" and bytes(got["https://a/2"].body) == b"https://a/2"


def test_crawl(spark):
    from corpusmill.config import Settings
    from corpusmill.sources.fetch import crawl

    html = {"content-type": "text/html"}
    pages = {
        "https://a.example/robots.txt": (200, {"content-type": "text/plain"}, b"User-agent: *\nDisallow: /secret"), "https://b.example/robots.txt": (404, {}, b""),
        "https://a.example/": (200, html, b"<a href='/x'>x</a><a href='/secret/y'>y</a><a href='https://b.example/z#f'>z</a><a href='https://z.example/'>out</a><a href='/hop'>h</a>"),
        "https://a.example/x": (200, html, b"<a href='/'>back</a><a href='/deep'>d</a>"), "https://b.example/z": (200, html, b"end"), "https://a.example/deep": (200, html, b"<a href='/deeper'>d</a>"),
        "https://a.example/hop": (302, {"location": "/secret/t"}, b""), "https://a.example/deeper": (200, html, b""),
    }

    def fetcher(url, headers):
        assert "secret" not in url and "z.example" not in url
        return pages.get(url, (404, {}, b""))

    seeds = spark.createDataFrame([("http://A.example/index.html#top",), ("https://a.example/",), ("https://z.example/",), (None,)], "url string")
    run = lambda **s: {r.url.split("://")[1]: (r.depth, r.status) for r in crawl(seeds, fetcher, Settings(allowed_hosts=("a.example", "b.example"), **s), delay_s=0).collect()}
    assert run(depth_cap=2) == {"a.example/": (0, "success"), "a.example/x": (1, "success"), "b.example/z": (1, "success"), "a.example/secret/y": (1, "skip"), "a.example/hop": (1, "skip"), "a.example/deep": (2, "success")}
    assert sum(v[1] != "skip" or k.endswith("hop") for k, v in run(max_pages=3).items()) == 3
    assert crawl(seeds.limit(0), fetcher, Settings(allowed_hosts=("a.example",)), delay_s=0).count() == 0


def test_seeds(tmp_path):
    import pytest

    from corpusmill.sources.seeds import load_seeds

    p = tmp_path / "seeds.yaml"
    p.write_text("seeds:\n  one: [https://a.example/x, https://A.example/y]\n  two: []\n")
    assert load_seeds(str(p), ("a.example",)) == {"one": ["https://a.example/x", "https://A.example/y"], "two": []}
    p.write_text("seeds:\n  one: [https://z.example/x]\n")
    with pytest.raises(ValueError):
        load_seeds(str(p), ("a.example",))
