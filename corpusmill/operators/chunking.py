"""Citation-exact chunks of extracted documents under a token limit.

A text is tokenised once into sorted token starts, so the tokens of any slice are a difference of two bisections
instead of another tokenisation. Every step works on character offsets: related small sections are joined, a group is
cut into paragraphs, long paragraphs into sentences, unbreakable runs into token windows, and the pieces are packed
into windows that overlap by whole sentences. ``full_text[char_start:char_end]`` is always the chunk's text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Callable
from itertools import takewhile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.config import DEFAULTS, Settings
from corpusmill.functions.arrow import map_columns

#: The spans (start, end) of a text's tokens, in order. A subword tokenizer gives the offsets that it reports.
Tokenizer = Callable[[str], list[tuple[int, int]]]
_TOKEN = re.compile(r"\w+|[^\w\s]")
_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
JOINER, SEPARATOR = "\n\n", " > "


def word_spans(text: str) -> list[tuple[int, int]]:
    """Runs of word characters and single marks."""
    return [m.span() for m in _TOKEN.finditer(text)]


def count_tokens(text: str | None, tokenizer: Tokenizer | None = None) -> int:
    """Tokens of a text, by itself."""
    return len((tokenizer or word_spans)(text)) if text else 0


class _Ruler:
    """Tokens of slices of one text."""

    def __init__(self, text: str, tokenizer: Tokenizer | None = None) -> None:
        self.text = text
        self.spans = [(a, b) for a, b in (tokenizer or word_spans)(text) if a < b]
        self.starts = [a for a, _ in self.spans]
        self.ends = [b for _, b in self.spans]

    def tokens(self, a: int, b: int) -> int:
        """A token cut by an end of the slice counts on both sides."""
        first = bisect_left(self.ends, a + 1)
        return max(0, bisect_left(self.starts, b) - first)

    def windows(self, a: int, b: int, limit: int) -> list[tuple[int, int]]:
        """[a, b) as adjoining slices of at most ``limit`` tokens that start at tokens."""
        out = []
        while self.tokens(a, b) > limit:
            after = self.starts[bisect_left(self.ends, a + 1) + limit]
            out.append((a, after))
            a = after
        return [*out, (a, b)] if a < b else out

    def parts(self, a: int, b: int, breaks: re.Pattern) -> list[tuple[int, int]]:
        """Trimmed slices between breaks."""
        edges = [a, *(x for m in breaks.finditer(self.text, a, b) for x in m.span()), b]
        out = []
        for x, y in zip(edges[::2], edges[1::2]):
            inner = self.text[x:y]
            x += len(inner) - len(inner.lstrip())
            y = x + len(inner.strip())
            if x < y:
                out.append((x, y))
        return out

    def pieces(self, limit: int) -> list[tuple[int, int]]:
        out = []
        for p in self.parts(0, len(self.text), _PARAGRAPH):
            if self.tokens(*p) <= limit:
                out.append(p)
                continue
            for s in self.parts(*p, _SENTENCE):
                out += [s] if self.tokens(*s) <= limit else self.windows(*s, limit)
        return out

    def packed(self, limit: int, overlap: int) -> list[tuple[int, int]]:
        """Windows of pieces; a window starts with the last whole sentences (never all) of the one before if they fit."""
        out: list[tuple[int, int]] = []
        for a, b in self.pieces(limit):
            if out and self.tokens(out[-1][0], b) <= limit:
                out[-1] = (out[-1][0], b)
                continue
            if out:
                tail = [x for x, _ in self.parts(*out[-1], _SENTENCE)[1:] if self.tokens(x, out[-1][1]) <= overlap]
                if tail and self.tokens(tail[0], b) <= limit:
                    a = tail[0]
            out.append((a, b))
        return out


def _kin(a: str, b: str) -> bool:
    """Equal headings, siblings under a heading, or parent and child."""
    up_a, up_b = (x.rpartition(SEPARATOR)[0] for x in (a, b))
    return a == b or bool(up_a and up_a == up_b) or bool(up_b and a == up_b) or bool(up_a and b == up_a)


def _shared(paths: list[str]) -> str:
    levels = zip(*(p.split(SEPARATOR) if p else [] for p in paths))
    return SEPARATOR.join(x[0] for x in takewhile(lambda x: len(set(x)) == 1, levels))


def chunk_document(blocks: list[tuple[str, str, str | None, int]], settings: Settings = DEFAULTS, tokenizer: Tokenizer | None = None) -> list[tuple]:
    """(text, heading_path, char_start, char_end, url_anchor, token_count) of each chunk of a document's blocks
    (text, heading_path, anchor_id, char_start), in reading order."""
    limit, small = settings.target_chunk_tokens, settings.small_section_tokens
    groups: list[list] = []  # [blocks, text, tokens]
    for block in blocks:
        text, path, _, start = block
        if not text or not text.strip():
            continue
        if groups:
            group, joined, tokens = groups[-1]
            before = group[-1]
            own = count_tokens(text, tokenizer)
            adjoins = start == before[3] + len(before[0]) + len(JOINER)
            if adjoins and _kin(before[1] or "", path or "") and min(tokens, own) < small and tokens + own <= limit:
                groups[-1] = [[*group, block], joined + JOINER + text, tokens + own]
                continue
        groups.append([[block], text, count_tokens(text, tokenizer)])
    out = []
    for group, text, _ in groups:
        base, path, anchor = group[0][3], _shared([b[1] or "" for b in group]), next((b[2] for b in group if b[2]), None)
        ruler, todo = _Ruler(text, tokenizer), deque()
        todo.extend(ruler.packed(limit, settings.overlap_tokens))
        while todo:  # a slice's own tokens may be more than its part of the whole text's: then it is cut again
            a, b = todo.popleft()
            n = count_tokens(text[a:b], tokenizer)
            if n > limit and b - a > 1:
                inner = _Ruler(text[a:b], tokenizer)
                parts = inner.windows(0, b - a, max(1, limit * limit // n))
                parts = parts if len(parts) > 1 else [(0, (b - a) // 2), ((b - a) // 2, b - a)]
                todo.extendleft((a + x, a + y) for x, y in reversed(parts))
                continue
            out.append((text[a:b], path, base + a, base + b, anchor, n))
    return out


def chunk_blocks(blocks: DataFrame, settings: Settings = DEFAULTS, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Chunks of all documents from (document_id, block_no, text, heading_path, anchor_id, char_start) rows; a
    document's blocks meet in one task, as the packing is sequential."""
    own = blocks.dropDuplicates(["document_id", "block_no"]).where("document_id is not null")
    grouped = own.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("block_no", "text", "heading_path", "anchor_id", "char_start"))).alias("blocks"))

    def run(ids: list, groups: list) -> tuple:
        rows = []
        for d, g in zip(ids, groups):
            rows += [(d, i, *c) for i, c in enumerate(chunk_document([(b["text"], b["heading_path"] or "", b["anchor_id"], b["char_start"]) for b in g], settings, tokenizer))]
        return tuple(map(list, zip(*rows))) if rows else tuple([] for _ in range(8))

    return map_columns(grouped, run, "document_id bigint, ordinal int, text string, heading_path string, char_start int, char_end int, url_anchor string, token_count int")
