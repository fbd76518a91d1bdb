"""Decoding and reading of fetched HTML."""

from __future__ import annotations

import html
import re

_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w-]+)", re.I)
_DROPPED = re.compile(r"<!--.*?-->|<(script|style|noscript|template|svg|pre|code|textarea)\b.*?</\1\s*>|<head\b.*?</head\s*>", re.S | re.I)
_BREAK = re.compile(r"<(?:/?(?:p|div|section|article|main|header|footer|nav|aside|ul|ol|li|table|tr|td|th|h[1-6]|form|blockquote|dl|dt|dd|dialog|figure|body|html|button|option)|br|hr)\b[^>]*>", re.I)
_TAG = re.compile(r"<[/a-zA-Z!][^<>%]*>")


def decoded(body: bytes, content_type: str | None = None) -> str:
    """Text of ``body``: by the header's charset, else UTF-8, else Latin-1; never fails."""
    named = _CHARSET.search(content_type or "") or _CHARSET.search(body[:1024].decode("latin-1"))
    for charset in (named[1] if named else "utf-8", "utf-8"):
        try:
            return body.decode(charset)
        except (LookupError, UnicodeDecodeError):
            pass
    return body.decode("latin-1")


def passages(page: str) -> list[str]:
    """The visible text of each block of a page; scripts, notices for browsers without scripts and code are left out."""
    text = _TAG.sub("", _BREAK.sub("\n", _DROPPED.sub(" ", page)))
    return [p for p in (html.unescape(x).strip() for x in text.split("\n")) if p]
