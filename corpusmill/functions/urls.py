"""URL canonicalisation and link policy as column expressions (no Python in the plan)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path prefixes, suffixes and parts that the policy names. (Fixed values.)
DENIED_PREFIXES = ("/_ato/", "/dist/", "/404/", "/.well-known/")
DENIED_SUFFIXES = (".css", ".js", ".min.css", ".min.js", ".map", ".ico", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".woff", ".woff2", ".ttf", ".eot", ".pdf.js")
ERROR_PATHS = ("/404/404.html", "/404.html", "/error/")
ERROR_QUERY = "req="

_any = lambda parts: "|".join(map(re.escape, parts))
_DENIED, _ERROR = rf"^(?:{_any(DENIED_PREFIXES)})|(?:{_any(DENIED_SUFFIXES)})$", _any(ERROR_PATHS)
_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(?:#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def host(url: Column) -> Column:
    """Lower-cased host without user and port; '' where there is none."""
    return F.lower(F.regexp_extract(authority(url), r"^(?:[^@]*@)?([^:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    """The query with its question mark, or ''."""
    return F.regexp_extract(url, _PARTS, 4)


def normalize_url(url: Column, allowed: Iterable[str]) -> Column:
    """Canonical https URL of an allowed host, else null: host in lower case, explicit port kept, parameters and
    fragment dropped, '/' for an empty path, a final ``index.html`` stripped, the query kept as it is."""
    url = F.trim(url)
    port = F.regexp_extract(authority(url), r"(:\d+)$", 1)
    bare = F.regexp_replace(path(url), r";[^/]*$", "")
    bare = F.regexp_replace(bare, r"/index\.html$", "/")
    bare = F.when(bare == "", "/").otherwise(bare)
    built = F.concat(F.lit("https://"), host(url), port, bare, F.when(query(url) == "?", "").otherwise(query(url)))
    return F.when(scheme(url).isin("http", "https", "") & host(url).isin(*allowed), built)


def is_navigational(href: Column) -> Column:
    """A link to follow: not empty, not only a fragment, no scheme but http(s)."""
    return F.coalesce((F.trim(href) != "") & ~F.trim(href).startswith("#") & scheme(F.trim(href)).isin("", "http", "https"), F.lit(False))


def is_crawlable(url: Column) -> Column:
    """An http(s) URL whose path is no asset and no denied area; the query doesn't matter, PDFs are allowed."""
    return F.coalesce(scheme(url).isin("http", "https") & ~F.lower(path(url)).rlike(_DENIED), F.lit(False))


def is_error_document(url: Column) -> Column:
    """A URL of a site's error pages."""
    return F.coalesce(F.contains(F.lower(query(url)), F.lit(ERROR_QUERY)) | F.lower(path(url)).rlike(_ERROR), F.lit(False))


def is_persistable(body: Column, content_hash: Column, status: Column) -> Column:
    """A fetch worth storing: status 200 with a body and a hash."""
    return F.coalesce((status == 200) & (F.octet_length(body) > 0) & (content_hash != ""), F.lit(False))


def classify_fetch(status: Column, host_allowed: Column, robots_allowed: Column, final_url: Column) -> Column:
    """'success', 'skip: …' or 'error: …' of a fetch; the order of the rules matters."""
    return (
        F.when(~F.coalesce(host_allowed, F.lit(False)), "skip: redirected off allowlist")
        .when(~F.coalesce(robots_allowed, F.lit(False)), "skip: robots.txt disallows redirect target")
        .when(is_error_document(final_url), "skip: error document")
        .when(status.isin(200, 304), "success")
        .otherwise(F.concat(F.lit("error: HTTP "), F.coalesce(status, F.lit(0)).cast("string")))
    )


def content_kind(content_type: Column) -> Column:
    """'pdf', 'html' or null; PDF is tested first."""
    low = F.lower(content_type)
    return F.when(F.contains(low, F.lit("application/pdf")), "pdf").when(F.contains(low, F.lit("text/html")), "html")
