"""Masking of personal identifiers, and back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrow import map_columns

#: Label and pattern, in the order of replacement. (Fixed values.)
PATTERNS = (
    ("EMAIL", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    ("PHONE", r"\b(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b"),
    ("STUDENT_NUMBER", r"\b\d{9}\b"),
    ("POSTAL", r"(?i)\b[A-Z]\d[A-Z][ -]?\d[A-Z]\d\b"),
)
_COMPILED = [(label, re.compile(p)) for label, p in PATTERNS]

_LETTER = r"\p{L}\p{N}_"
_BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def jvm_pattern(pattern: str) -> str:
    """The same pattern for the JVM, where classes and word bounds are ASCII unless they are spelled out: letters and
    digits of all scripts, so that no address with an accent stays in clear."""
    out, inside = [], False
    for part in re.findall(r"\\.|\(\?i\)|.", pattern):
        inside = part == "[" or inside and part != "]"
        classes = {r"\w": _LETTER, r"\d": r"\p{Nd}", r"\s": _BLANK}
        if part in classes:
            out.append(classes[part] if inside else f"[{classes[part]}]")
        elif part == r"\b":
            out.append(f"(?:(?<=[{_LETTER}])(?![{_LETTER}])|(?<![{_LETTER}])(?=[{_LETTER}]))")
        else:
            out.append("(?iu)" if part == "(?i)" else part)
    return "".join(out)


_JVM = [(label, jvm_pattern(p)) for label, p in PATTERNS]


def mask(text: Column) -> Column:
    """Every identifier replaced by ⟨LABEL⟩, in the JVM; the same ones as ``redact_text`` finds."""
    for label, p in _JVM:
        text = F.regexp_replace(text, p, f"⟨{label}⟩")
    return text


def counts(text: Column) -> dict[str, Column]:
    """Identifiers by label, each counted after the labels before it were masked."""
    out = {}
    for label, p in _JVM:
        out[label] = F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0))
        text = F.regexp_replace(text, p, f"⟨{label}⟩")
    return out


def redact_text(text: str) -> tuple[str, dict[str, str]]:
    """(text with ⟨LABEL_n⟩ for each identifier, what each one stands for)."""
    kept: dict[str, str] = {}
    for label, pattern in _COMPILED:
        numbered = iter(range(1, len(text) + 2))

        def token(m: re.Match, label: str = label, numbered: object = numbered) -> str:
            name = f"⟨{label}_{next(numbered)}⟩"
            kept[name] = m.group()
            return name

        text = pattern.sub(token, text)
    return text, kept


def redact(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, redacted, placeholders of each row."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema}[key]

    def run(keys: list, texts: list) -> tuple:
        both = [(None, None) if t is None else redact_text(t) for t in texts]
        return keys, [a for a, _ in both], [b if b is None else list(b.items()) for _, b in both]

    own = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return map_columns(own, run, f"_key {kind}, redacted string, placeholders map<string,string>").withColumnRenamed("_key", key)


def restore(redacted: Column, placeholders: Column) -> Column:
    """The text before ``redact``."""
    return F.aggregate(F.map_entries(placeholders), redacted, lambda text, e: F.replace(text, e["key"], e["value"]))
