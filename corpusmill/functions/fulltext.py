"""Full-text analysis: analyzers, positions and cover-density rank."""

from __future__ import annotations

import functools
import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[^\W_]+")
#: English stop words. (Fixed values.)
STOP = frozenset(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have "
    "having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she "
    "should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with "
    "you your yours yourself yourselves".split()
)
#: Tables of the published English (Porter 2) stemming algorithm: endings and what they become. (Fixed values.)
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
_KEPT_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
_THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_HEAD = re.compile(r"^(?:gener|commun|arsen)")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant behind a vowel, and the same once more."""
    head, first = _HEAD.match(word), _REGION.search(word)
    r1 = head.end() if head else first.end() if first else len(word)
    second = _REGION.search(word, r1)
    return r1, second.end() if second else len(word)


def _ending(word: str, endings: object) -> str | None:
    """The longest of ``endings`` that the word ends in."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@functools.lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The English (Porter 2) stem of a lower-cased word; words of other scripts stay as they are."""
    if len(word) < 3 or not word.isascii() or word in _KEPT:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = re.sub(r"(?<=[aeiouy])y|^y", "Y", word)
    r1, r2 = _regions(word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(r"[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in _KEPT_AFTER_PLURAL:
        return word
    end = _ending(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        word = word[: -len(end)] + "ee" if len(word) - len(end) >= r1 else word
    elif end and re.search(r"[aeiouy]", word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLE):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT_END.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    end = _ending(word, _SECOND)
    if end and len(word) - len(end) >= r1:
        before = word[: -len(end)]
        if (end != "ogi" or before.endswith("l")) and (end != "li" or before[-1:] in tuple("cdeghkmnrt")):
            word = before + _SECOND[end]
    end = _ending(word, _THIRD)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + _THIRD[end]
    end = _ending(word, _FOURTH)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _SHORT_END.search(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def analyze(text: str | None, analyzer: str = "simple") -> list[tuple[str, int]]:
    """(lexeme, 1-based position) of a text: 'simple' lower-cases, 'english' also drops stop words and stems."""
    words = _TOKEN.findall((text or "").lower())
    if analyzer == "simple":
        return [(w, i) for i, w in enumerate(words, 1)]
    if analyzer != "english":
        raise ValueError(f"unknown analyzer {analyzer}")
    return [(stem(w), i) for i, w in enumerate(words, 1) if w not in STOP]


def tsv(text: str | None, analyzer: str = "english") -> dict[str, list[int]]:
    """Positions by lexeme of a text: the stored full-text column."""
    places: dict[str, list[int]] = {}
    for t, p in analyze(text, analyzer):
        places.setdefault(t, []).append(p)
    return places


def lexemes(text: Column) -> Column:
    """The 'simple' lexemes in order, in the JVM."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def cover_rank(positions: list[list[int]], weight: float = 0.1) -> float:
    """Cover density: the sum over minimal extents that hold every query lexeme of weight / (1 + words between)."""
    k = len(positions)
    if not k or not all(positions):
        return 0.0
    marks = sorted((p, i) for i, ps in enumerate(positions) for p in ps)
    inside: Counter = Counter()
    total, low = 0.0, 0
    for high, (p, i) in enumerate(marks):
        inside[i] += 1
        if len(inside) < k:
            continue
        while inside[marks[low][1]] > 1:
            inside[marks[low][1]] -= 1
            low += 1
        total += weight / (1 + (p - marks[low][0]) - (k - 1) if k > 1 else 1)
        del inside[marks[low][1]]
        low += 1
    return total
