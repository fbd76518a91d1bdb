"""The quality gate of extracted text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of consent dialogues that a usable text never holds. (Fixed values.)
CONSENT_PHRASES = (
    "by selecting accept all", "we use cookies to provide you with the best", "consent to our use of cookies", "privacy preference center",
    "strictly necessary cookies", "performance cookies", "cookie policy", "onetrust",
)
FLOOR_TOKENS = 80


def token_count(text: Column) -> Column:
    """Runs of letters and digits, and single other marks, in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")), F.lit(0))


def boilerplate_hits(text: Column) -> Column:
    """How many of the phrases the text holds, whatever the case."""
    low, hits = F.lower(text), F.lit(0)
    for phrase in CONSENT_PHRASES:
        hits = hits + F.coalesce(F.contains(low, F.lit(phrase)), F.lit(False)).cast("int")
    return hits


def is_usable(text: Column, floor: int = FLOOR_TOKENS, most_hits: int = 0) -> Column:
    """Not blank, long enough, without consent phrases; false for null."""
    return F.coalesce((F.trim(text) != "") & (token_count(text) >= floor) & (boilerplate_hits(text) <= most_hits), F.lit(False))
