"""Splitting oversized items at natural boundaries (problem 3).

Agglomerative merging: a text is cut into atoms (words with what follows them; unbroken runs are cut hard), every
adjacent pair waits in a heap under the strength of the boundary between them, and the weakest boundary is merged
first while the combined size plus the overlap fits under the limit. What remains are cuts at the strongest
boundaries: blank lines before line ends, line ends before sentence ends, those before clauses, words and runs.

Only items over the limit (found by ``char_length`` in the JVM) reach the Arrow function; whole texts are split.
Defined cases: null and short texts give no pieces; a limit not above twice the overlap is refused; repeated rows
give each piece once; sizes count Unicode code points.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrow import columns, map_columns

LIMIT = 2400
OVERLAP = 200

_ATOM = re.compile(r"\s*\S+\s*")
_SENTENCE = re.compile(r"[.!?…。！？]['\")\]»”]*\s+$")
_CLAUSE = re.compile(r"[,;:–—]\s+$")


def _strength(atom: str) -> int:
    """Strength of the boundary behind an atom."""
    tail = atom[len(atom.rstrip()) :]
    if tail.count("\n") > 1:
        return 5
    if "\n" in tail or "\r" in tail:
        return 4
    if not tail:
        return 0
    return 3 if _SENTENCE.search(atom) else 2 if _CLAUSE.search(atom) else 1


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, own_start, end) of each piece: ``text[start:end]`` has at most ``limit`` characters, ``own_start - start``
    of them (at most ``overlap``) repeat the end of the piece before; the own parts tile the text."""
    if limit <= 2 * overlap:
        raise ValueError("limit must be more than twice the overlap")
    if len(text) <= limit:
        return [(0, 0, len(text))] if text else []
    room = limit - overlap
    ends: list[int] = []
    power: list[int] = []
    for m in _ATOM.finditer(text):
        start, end = m.span()
        while end - start > room:
            start += room
            ends.append(start)
            power.append(0)
        ends.append(end)
        power.append(_strength(text[start:end]))
    if not ends:  # white space only
        ends, power = [*range(room, len(text), room), len(text)], [0] * (-(-len(text) // room))
    n = len(ends)
    begin = [0, *ends[:-1]]
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    last = list(range(n))  # last atom of the group that begins at an atom
    alive = [True] * n
    heap = [(power[i], ends[i + 1] - begin[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, a, b = heapq.heappop(heap)
        if not (alive[a] and b < n and alive[b]) or right[a] != b or ends[last[b]] - begin[a] != size:
            continue
        if size > room:  # neither side ever shrinks, so this boundary stays
            continue
        last[a], right[a], alive[b] = last[b], right[b], False
        if right[a] < n:
            left[right[a]] = a
            heapq.heappush(heap, (power[last[a]], ends[last[right[a]]] - begin[a], a, right[a]))
        if left[a] >= 0:
            heapq.heappush(heap, (power[last[left[a]]], ends[last[a]] - begin[left[a]], left[a], a))
    out, a = [], 0
    while a < n:
        own, end = begin[a], ends[last[a]]
        out.append((_overlap_start(text, own, overlap), own, end))
        a = right[a]
    return out


def _overlap_start(text: str, own: int, overlap: int) -> int:
    """Where the overlap before ``own`` starts: behind the earliest sentence or line end in reach, else behind a word."""
    low = max(0, own - overlap)
    if low == 0 or own == 0:
        return 0 if own <= overlap else low
    before = text[low:own]
    for pattern in (r"\n+|[.!?…]['\")\]»”]*\s+", r"\s+"):
        for m in re.finditer(pattern, before):
            if m.end() < len(before):
                return low + m.end()
    return low


def split_oversized(
    df: DataFrame, keys: list[str], text: str = "text", heading: str = "heading_path", limit: int = LIMIT, overlap: int = OVERLAP
) -> DataFrame:
    """keys, piece_no, char_start, own_start, char_end, heading, text of the pieces of every item over ``limit``."""
    named = [f"_k{i}" for i in range(len(keys))]
    big = df.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], F.col(heading).alias("_heading"), F.col(text).alias("_text"))
    big = big.where(F.char_length("_text") > limit).distinct()
    kinds = {f.name: f.dataType.simpleString() for f in big.schema}
    schema = ", ".join(f"{n} {kinds[n]}" for n in named) + ", piece_no int, char_start int, own_start int, char_end int, _heading string, _text string"

    def pieces(*cols: list) -> tuple:
        rows = [(*r[:-2], i, s, o, e, r[-2], r[-1][s:e]) for r in zip(*cols) for i, (s, o, e) in enumerate(split_text(r[-1], limit, overlap))]
        return columns(rows, len(named) + 6)

    out = map_columns(big, pieces, schema)
    return out.select(*[F.col(n).alias(k) for n, k in zip(named, keys)], "piece_no", "char_start", "own_start", "char_end", F.col("_heading").alias(heading), F.col("_text").alias(text))
