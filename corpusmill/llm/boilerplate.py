"""Page boilerplate mixed with main content (problem 2).

Gradient-boosted trees score the text nodes of a page's tree (DOM). Features: the attribute tokens of the elements
above (their learnt log-odds and hashed presence), depth, density of text and links in the subtrees around the node,
its siblings, and its words and shape. Hierarchical decoding then labels the whole tree at once: a subtree is all
furniture, all content, or mixed at a price, so ancestors and descendants never contradict.

Extracted text is read as a tree too: blocks between blank lines, their lines the leaves. A document is joined to its
fetched page (same url; the same content hash before the newest), and each line that stands in the page takes over the
features of its node; lines without a node, and documents without a page, are judged by words, shape and place.

Training: a bounded sample (``SAMPLE_DOCUMENTS`` documents with their pages, least hash of the id). Labels of nodes come
from elements that say what they are (nav, footer, aside, main, article and the like) and are carried over to the lines
of the documents; a line that isn't prose and that its page, byte for byte the one extracted, doesn't hold was added
around the content. In half of the sample all features of the page's tree are hidden, so that the trees learn to judge
without them. Nothing else is given: no wording stands in this file. Everything but the training sees all rows.

Lines that are residue of problem 1 are no furniture, whatever they stand in.

Defined cases: null, empty and blank texts have no furniture and no body; pages without any text give an empty body;
nesting may be of any depth; repeated rows are found once; without anything to learn from, nothing is furniture.
"""

from __future__ import annotations

import html
import json
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.arrow import map_columns
from corpusmill.functions.html import decoded
from corpusmill.llm.boosting import Boosted
from corpusmill.llm.residue import residue_kind
from corpusmill.session import small_side, spread

SAMPLE_DOCUMENTS = 1_000
SAMPLE_NODES = 60_000
MIXED_PRICE = 3.0
CLIP = 4.0
BATCH = 256
HASHED = 16
MISSING = -1000.0

_WORD = re.compile(r"[^\W\d_]+|\d+|[©›»|·/:>→—–?!•]")
_BULLET = re.compile(r"^\s*[•*–-]\s")
_DATE = re.compile(r"\b\d{4}-\d\d-\d\d\b|\b\d\d?[./]\d\d?[./]\d{2,4}\b|\b\d{1,2} [A-Za-zäéûñ]{3,10} \d{4}\b")
_DIGIT, _CAPITAL, _SEPARATOR = re.compile(r"\d"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[|·›»—→]")
_PLAIN = re.compile(r"[^\W_]+")
TEXT_FEATURES = 36
DOM_FEATURES = 13 + HASHED
RESIDUE = 24  # the column of text features that says that a text is residue of problem 1


def _tokens(text: str) -> list[str]:
    return ["#" if t.isdigit() else t for t in _WORD.findall(text.lower())]


def _grams(tokens: list[str]) -> list[str]:
    edge = ["<", *tokens, ">"]
    return [f"{a} {b}" for a, b in zip(edge, edge[1:])]


def _key(text: str) -> str:
    return " ".join(_PLAIN.findall(text.lower()))


def _odds(counts: dict, total: tuple[float, float], least: float) -> dict[str, float]:
    """Log-odds for furniture of what was counted by label."""
    return {x: math.log((c[1] + 0.5) / total[1]) - math.log((c[0] + 0.5) / total[0]) for x, c in counts.items() if sum(c) >= least}


class Wordings:
    """Log-odds of words and word pairs for furniture, from labelled texts; a wording counts at most 20 times a part."""

    def __init__(self, labelled: Iterable[tuple[str, int]] = (), parts: Iterable[Wordings] = ()) -> None:
        """Counts ``labelled`` texts, or puts together what ``parts`` counted."""
        self.counts: tuple[dict, dict] = ({}, {})
        self.total, seen = [1.0, 1.0], Counter()
        for text, label in labelled:
            key = (text, label)
            seen[key] += 1
            tokens = _tokens(text) if seen[key] == 1 else []
            wording = (" ".join(tokens), label)
            seen[wording] += 1
            if not tokens or seen[wording] > 20:
                continue
            self.total[label] += 1
            for table, items in zip(self.counts, (set(tokens), set(_grams(tokens)))):
                for x in items:
                    table.setdefault(x, [0, 0])[label] += 1
        for part in parts:
            self.total = [a + b for a, b in zip(self.total, part.total)]
            for table, counted in zip(self.counts, part.counts):
                for x, c in counted.items():
                    known = table.setdefault(x, [0, 0])
                    known[0] += c[0]
                    known[1] += c[1]
        self.words, self.pairs = (_odds(c, (self.total[0], self.total[1]), 3) for c in self.counts)

    def features(self, text: str) -> list[float]:
        tokens = _tokens(text)
        known = self.words
        w = [known[t] for t in tokens if t in known] or [0.0]
        known = self.pairs
        p = [known[t] for t in _grams(tokens) if t in known] or [0.0]
        n, a, b = len(tokens) or 1, sum(w), sum(p)
        return [a, a / len(w), max(w), min(w), len(w) / n, b, b / len(p), max(p), min(p), len(p) / (n + 1)]


def _shape(text: str) -> list[float]:
    flat = text.strip()
    words = flat.split()
    size, capital = len(flat), len(_CAPITAL.findall(flat))
    return [
        size, len(words), len(_DIGIT.findall(flat)) / size, capital / size, size / len(words), flat[-1] in ".!?…", flat[0].isupper(), bool(_BULLET.match(text)),
        size < 200 and bool(_DATE.search(flat)), len(_SEPARATOR.findall(flat)), flat.count("\t"), "," in flat, residue_kind(text) is not None,
    ]


def text_features(groups: list[list[str]], wordings: Wordings) -> np.ndarray:
    """One row for each text of each group of siblings: words, shape, place and surroundings."""
    rows: list[list[float]] = []
    own = [[(wordings.features(t), _shape(t)) for t in g] for g in groups]
    signs = [[w[5] + w[0] for w, _ in g] for g in own]
    means = [sum(v) / len(v) for v in signs]
    for k, g in enumerate(own):
        n, sign = len(g), signs[k]
        sizes = [s[0] for _, s in g]
        total, top, low, around = sum(sign), max(sign), min(sign), [sum(sizes) / n, max(sizes), sum(x < 60 for x in sizes) / n]
        outside = [means[k - 1] if k else 0.0, means[k + 1] if k + 1 < len(own) else 0.0, k / len(own)]
        for i, (w, s) in enumerate(g):
            rows.append([
                *w, n, i / n, *s, *around, (total - sign[i]) / max(1, n - 1), sign[i - 1] if i else 0.0, sign[i + 1] if i + 1 < n else 0.0, top, low, *outside,
            ])
    return np.array(rows, float).reshape(-1, TEXT_FEATURES)


_MARKUP = re.compile(r"<!--.*?-->|<(script|style|noscript|template|svg|textarea|title)\b.*?</\1\s*>|<(/?)([a-zA-Z][\w-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<![^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*[\"']?([^\"'>]*)", re.I)
_INLINE = frozenset("a abbr b bdi cite code em i label small span strong sub sup time u mark font q s".split())
_VOID = frozenset("br hr img input meta link source wbr area base col embed".split())
#: Element names, roles and usual names of classes that say what an element holds: where the labels come from.
_FURNITURE_TOKENS = frozenset("nav footer aside dialog navigation contentinfo complementary banner menu bottom consent cookie cookies notice rail sidebar side breadcrumb breadcrumbs share related".split())
_CONTENT_TOKENS = frozenset("main article content".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _told(tokens: tuple[str, ...]) -> int:
    """1 for furniture, 0 for content, -1 unknown, by the last telling token of an element."""
    for t in reversed(tokens):
        if t in _FURNITURE_TOKENS:
            return 1
        if t in _CONTENT_TOKENS:
            return 0
    return -1


class Page:
    """A page's tree in document order: ``parents`` and ``tokens`` of its elements (0 is the root), and its texts with
    their elements, their share of links and their groups of siblings. Parents come before children everywhere, so
    whatever goes up or down the tree is one loop."""

    def __init__(self, source: str) -> None:
        self.parents, self.tokens, self.depth, self.told, self.heading = [-1], [("body",)], [0], [-1], [False]
        self.texts: list[str] = []
        self.at: list[int] = []
        self.links: list[float] = []
        stack, place, text, linked, inside = [("", 0)], 0, [], 0, False
        opened: Counter = Counter()

        def flush() -> None:
            nonlocal linked
            raw = "".join(text)
            own = html.unescape(raw).strip()
            text.clear()
            if own:
                self.texts.append(own)
                self.at.append(stack[-1][1])
                self.links.append(min(1.0, linked / len(raw)))
            linked = 0

        for m in _MARKUP.finditer(source):
            piece = source[place : m.start()]
            text.append(piece)
            linked += len(piece) if inside else 0
            place = m.end()
            name = (m[3] or "").lower()
            if name == "a":
                inside = not m[2]
            if not name or name in _INLINE:
                continue
            flush()
            if m[2]:
                if opened[name]:
                    while True:
                        closed = stack.pop()[0]
                        opened[closed] -= 1
                        if closed == name:
                            break
            elif name not in _VOID and not m[4].endswith("/"):
                up = stack[-1][1]
                tokens = (name, *re.findall(r"[a-z]+", " ".join(_ATTRIBUTE.findall(m[4])).lower()))
                told = _told(tokens)
                self.parents.append(up)
                self.tokens.append(tokens)
                self.depth.append(self.depth[up] + 1)
                self.told.append(told if told >= 0 else self.told[up])
                self.heading.append(self.heading[up] or name in _HEADINGS)
                stack.append((name, len(self.parents) - 1))
                opened[name] += 1
        text.append(source[place:])
        flush()
        held = [0] * len(self.parents)
        for p in self.parents[1:] + self.at:
            held[p] += 1
        home = [self.parents[v] if v and held[v] == 1 else v for v in self.at]  # an element of one text joins its siblings
        order: dict[int, list[int]] = {}
        for i, v in enumerate(home):
            order.setdefault(v, []).append(i)
        self.home, self.groups = home, list(order.values())

    def labels(self) -> list[int]:
        """Label of each text by what its elements say, -1 if they say nothing; headings name either."""
        return [-1 if self.heading[v] else self.told[v] for v in self.at]

    def path(self, i: int) -> set[str]:
        """All attribute tokens above text ``i``."""
        found, v = set(), self.at[i]
        while v >= 0:
            found.update(self.tokens[v])
            v = self.parents[v]
        return found

    def features(self, odds: dict[str, float]) -> np.ndarray:
        """DOM features, a row a text: attribute tokens, depth, subtree density of text and links."""
        n = len(self.parents)
        size, link, tags, kids = [0.0] * n, [0.0] * n, [1.0] * n, [0] * n
        for v, t, share in zip(self.at, self.texts, self.links):
            size[v] += len(t)
            link[v] += len(t) * share
        for v in range(n - 1, 0, -1):
            p = self.parents[v]
            size[p] += size[v]
            link[p] += link[v]
            tags[p] += tags[v]
            kids[p] += 1
        own, total, top, low, bits = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0] * n
        for v in range(n):
            p = self.parents[v]
            values = [odds[t] for t in self.tokens[v] if t in odds]
            mask = 0
            for t in self.tokens[v]:
                mask |= 1 << zlib.crc32(t.encode()) % HASHED
            strongest = max(values, key=abs, default=0.0)
            if p >= 0:
                own[v] = strongest if abs(strongest) > 1 else own[p]  # the innermost that tells
                total[v], top[v], low[v], bits[v] = total[p] + sum(values), max(top[p], *values, -99), min(low[p], *values, 99), bits[p] | mask
            else:
                own[v], total[v], top[v], low[v], bits[v] = strongest, sum(values), max(values, default=0.0), min(values, default=0.0), mask
        rows = []
        for v, u, share in zip(self.at, self.home, self.links):
            w = max(0, self.parents[u])
            rows.append([
                own[v], total[v], top[v], low[v], self.depth[u], share, math.log1p(size[u]), size[u] / tags[u], link[u] / (size[u] or 1), kids[u],
                math.log1p(size[w]), size[w] / tags[w], link[w] / (size[w] or 1), *((bits[v] >> k) & 1 for k in range(HASHED)),
            ])
        return np.array(rows, float).reshape(-1, DOM_FEATURES)


def decode(parents: list[int], at: list[int], logits: list[float], price: float = MIXED_PRICE) -> list[bool]:
    """Labels of the leaves of a tree: a subtree is all furniture, all content, or mixed at a price (free at the root and
    where there is nothing to choose between). ``parents``: of the inner nodes, each before its children; ``at``: the
    node of each leaf."""
    n = len(parents)
    total, parts, count = [0.0] * n, [0.0] * n, [0] * n
    for v, s in zip(at, logits):
        total[v] += s
        parts[v] += abs(s)
        count[v] += 1
    for v in range(n - 1, 0, -1):
        p = parents[v]
        total[p] += total[v]
        parts[p] += max(abs(total[v]), parts[v] - (price if count[v] > 1 else 0.0))
        count[p] += 1
    label: list[bool | None] = [None] * n
    for v in range(n):
        above = label[parents[v]] if v else None
        mixed = parts[v] - (price if v and count[v] > 1 else 0.0) > abs(total[v])
        label[v] = above if above is not None else (None if mixed else total[v] > 0)
    return [s > 0 if label[v] is None else bool(label[v]) for v, s in zip(at, logits)]


class Text:
    """An extracted text as a tree: root, blocks between blank lines, lines."""

    def __init__(self, text: str | None) -> None:
        self.split, self.groups = (text or "").split("\n"), []
        gap = True
        for i, line in enumerate(self.split):
            blank = not line or line.isspace()
            if not blank:
                if gap:
                    self.groups.append([])
                self.groups[-1].append(i)
            gap = blank
        self.numbers = [i for g in self.groups for i in g]

    def texts(self) -> list[list[str]]:
        return [[self.split[i] for i in g] for g in self.groups]

    def nodes(self, page: Page | None) -> list[list[int]]:
        """For each line the texts of the page that say the same."""
        known: dict[str, list[int]] = {}
        if page is not None:
            for i, t in enumerate(page.texts):
                known.setdefault(_key(t), []).append(i)
        keys = [_key(self.split[i]) for i in self.numbers]
        return [known.get(k, []) if k else [] for k in keys]

    def carried(self, page: Page, rows: np.ndarray) -> np.ndarray:
        """DOM features of the lines: those of their node, missing where there is none or where nodes differ."""
        out = np.full((len(self.numbers), DOM_FEATURES), MISSING)
        for k, found in enumerate(self.nodes(page)):
            if found and len({page.told[page.at[i]] for i in found}) == 1:
                out[k] = rows[found[0]]
        return out


def _prose(line: str) -> bool:
    return line.rstrip()[-1:] in ".!?…" and len(line.split()) >= 8


def line_labels(text: Text, page: Page, same: bool) -> list[int]:
    """Labels carried over from the page's nodes; ``same``: the text was extracted from just these bytes."""
    told, out = page.labels(), []
    for i, found in zip(text.numbers, text.nodes(page)):
        labels = {told[k] for k in found}
        if residue_kind(text.split[i]):
            out.append(0)
        elif found:
            out.append(labels.pop() if len(labels) == 1 else -1)
        else:
            out.append(1 if same and not _prose(text.split[i]) else -1)
    return out


class Sampled:
    """A labelled tree of the sample: a page or a document's text."""

    def __init__(self, groups: list[list[str]], labels: list[int], page: Page | None, text: Text | None, order: list[int]) -> None:
        self.groups, self.labels, self.page, self.text, self.order = groups, labels, page, text, order

    def labelled(self) -> list[tuple[str, int]]:
        flat = [t for g in self.groups for t in g]
        return [(t, y) for t, y in zip(flat, self.labels) if y >= 0]

    def dom(self, odds: dict[str, float]) -> np.ndarray:
        if self.page is None:
            return np.full((len(self.labels), DOM_FEATURES), MISSING)
        rows = self.page.features(odds)
        return self.text.carried(self.page, rows) if self.text is not None else rows[self.order]


#: (text or None, body or None, content type, whether the text was extracted from these bytes)
Row = tuple[str | None, bytes | None, str | None, bool]


def labelled_trees(sample: list[Row], nodes: int = SAMPLE_NODES) -> list[Sampled]:
    """The sample's pages and texts with their labels, up to about ``nodes`` labelled nodes."""
    trees, count = [], 0
    for text, body, kind, same in sample:
        if body is None or count >= nodes:
            continue
        page = Page(decoded(body, kind))
        told, order = page.labels(), [i for g in page.groups for i in g]
        own = [Sampled([[page.texts[i] for i in g] for g in page.groups], [told[i] for i in order], page, None, order)]
        if text and not text.isspace():
            t = Text(text)
            own.append(Sampled(t.texts(), line_labels(t, page, same), page, t, []))
        trees += own
        count += sum(y >= 0 for s in own for y in s.labels)
    return trees


class Furniture:
    """The trained model."""

    def __init__(self, trees: list[Sampled], seed: int = 7) -> None:
        self.wordings, self.odds, self.trees = Wordings(), {}, None
        labels = [y for t in trees for y in t.labels if y >= 0]
        if len(set(labels)) < 2:
            return
        halves = [Wordings(x for i, t in enumerate(trees) if i // 2 % 2 == k for x in t.labelled()) for k in (0, 1)]
        self.wordings, self.odds = Wordings(parts=halves), self._token_odds(trees)
        rng, x, y = random.Random(seed), [], []
        for i, t in enumerate(trees):  # words are judged by the other half, so that none vouches for itself
            keep = [k for k, label in enumerate(t.labels) if label >= 0]
            if not keep:
                continue
            dom = t.dom(self.odds)
            if rng.random() < 0.5:
                dom[:] = MISSING
            x.append(np.concatenate([text_features(t.groups, halves[1 - i // 2 % 2]), dom], 1)[keep])
            y += [t.labels[k] for k in keep]
        for w in (self.wordings, *halves):
            w.counts = ({}, {})  # the model travels with every task
        target = np.array(y, float)
        mass = np.ones(len(target))
        for k in (0.0, 1.0):
            mass[target == k] *= 0.5 * len(target) / (target == k).sum()
        self.trees = Boosted().fit(np.concatenate(x), target, mass)

    @staticmethod
    def _token_odds(trees: list[Sampled]) -> dict[str, float]:
        counts: dict = {}
        total = [1.0, 1.0]
        for t in trees:
            if t.text is None:
                for k, label in zip(t.order, t.labels):
                    if label >= 0:
                        total[label] += 1
                        for token in t.page.path(k):
                            counts.setdefault(token, [0, 0])[label] += 1
        return _odds(counts, (total[0], total[1]), 20)

    def to_json(self) -> str:
        return json.dumps({"words": self.wordings.words, "pairs": self.wordings.pairs, "odds": self.odds, "trees": self.trees and self.trees.to_dict()})

    @classmethod
    def from_json(cls, kept: str) -> Furniture:
        got, model = json.loads(kept), cls([])
        model.wordings.words, model.wordings.pairs, model.odds = got["words"], got["pairs"], got["odds"]
        model.trees = Boosted.from_dict(got["trees"]) if got["trees"] else None
        return model

    def save(self, spark: SparkSession, path: str) -> None:
        """Keeps the model in a folder of any file system that Spark knows."""
        spark.createDataFrame([(self.to_json(),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Furniture:
        return cls.from_json(spark.read.parquet(path).first()[0])

    def _scores(self, rows: list[np.ndarray]) -> list[list[float]]:
        """Clipped logits of each matrix, all scored together; without a model all are content."""
        if not rows:
            return []
        all_rows = np.concatenate(rows)
        score = self.trees.logits(all_rows).clip(-CLIP, CLIP) if self.trees is not None else np.full(len(all_rows), -CLIP)
        return [x.tolist() for x in np.split(score, np.cumsum([len(r) for r in rows])[:-1])]

    def lines(self, text: str | None, page: str | None = None) -> list[int]:
        """Numbers of the furniture lines of an extracted text."""
        return self.many_lines([text], [page])[0]

    def many_lines(self, texts: list[str | None], pages: list[str | None]) -> list[list[int]]:
        """``lines`` of many texts, scored together."""
        trees, rows = [Text(t) for t in texts], []
        for t, source in zip(trees, pages):
            dom = np.full((len(t.numbers), DOM_FEATURES), MISSING)
            if source is not None and t.numbers:
                page = Page(source)
                dom = t.carried(page, page.features(self.odds))
            rows.append(np.concatenate([text_features(t.texts(), self.wordings), dom], 1))
        out = []
        for t, own, score in zip(trees, rows, self._scores(rows)):
            at = [k + 1 for k, g in enumerate(t.groups) for _ in g]
            labels = decode([-1] + [0] * len(t.groups), at, score)
            out.append([i for i, furniture, residue in zip(t.numbers, labels, own[:, RESIDUE]) if furniture and not residue])
        return out

    def body(self, page: str) -> str:
        """Text of a page's main body."""
        return self.bodies([page])[0]

    def bodies(self, pages: list[str]) -> list[str]:
        """``body`` of many pages, scored together."""
        trees = [Page(p) for p in pages]
        return ["\n\n".join(t for t, furniture in zip(p.texts, labels) if not furniture) for p, labels in zip(trees, self.page_labels(trees))]

    def page_labels(self, pages: list[Page], hidden: bool = False) -> list[list[bool]]:
        """Whether each text of each page is furniture; ``hidden``: without the features of the tree, for measuring."""
        rows, orders = [], [[i for g in p.groups for i in g] for p in pages]
        for p, order in zip(pages, orders):
            dom = np.full((len(order), DOM_FEATURES), MISSING) if hidden else p.features(self.odds)[order]
            rows.append(np.concatenate([text_features([[p.texts[i] for i in g] for g in p.groups], self.wordings), dom], 1))
        out = []
        for p, order, score in zip(pages, orders, self._scores(rows)):
            logit = [0.0] * len(order)
            for i, s in zip(order, score):
                logit[i] = 0.0 if p.heading[p.at[i]] else s  # a heading goes with what stands around it
            out.append(decode(p.parents, p.at, logit))
        return out


def trained(sample: list[Row], nodes: int = SAMPLE_NODES) -> Furniture:
    """The model learnt from a sample."""
    return Furniture(labelled_trees(sample, nodes))


def held_out(sample: list[tuple[str, Row]]) -> list[tuple[str, int, float, float]]:
    """(what, nodes, precision, recall) on hosts that the model hasn't seen: a third of the hosts of (host, row).

    Truth is what the pages' elements say; their features are hidden from the trees ('… unmarked') or not.
    """
    away = set(sorted({h for h, _ in sample}, key=lambda h: (zlib.crc32(h.encode()), h))[::3])
    model, rest = trained([r for h, r in sample if h not in away]), [r for h, r in sample if h in away]
    tallies: dict[str, list[int]] = {}

    def tally(what: str, pairs: Iterable[tuple[int, bool]]) -> None:
        t = tallies.setdefault(what, [0, 0, 0, 0])
        for truth, found in pairs:
            if truth >= 0:
                for k, hit in enumerate((True, found, truth == 1, truth == 1 and found)):
                    t[k] += hit

    for text, body, kind, same in rest:
        if body is None:
            continue
        source = decoded(body, kind)
        page = Page(source)
        tally("nodes", zip(page.labels(), model.page_labels([page])[0]))
        tally("nodes unmarked", zip(page.labels(), model.page_labels([page], hidden=True)[0]))
        if text and not text.isspace():
            t = Text(text)
            labels = line_labels(t, page, same)
            for what, given in (("lines", source), ("lines unmarked", None)):
                found = set(model.lines(text, given))
                tally(what, ((y, i in found) for i, y in zip(t.numbers, labels)))
    return [(what, n, both / (found or 1), both / (true or 1)) for what, (n, found, true, both) in sorted(tallies.items())]


def _fetches(pages: DataFrame) -> DataFrame:
    return pages.where("body is not null and url is not null and fetch_id is not null").select(
        "url", F.lower("content_hash").alias("_hash"), F.struct("fetched_at", "fetch_id", F.xxhash64("body").alias("sum")).alias("_fetch"))


def chosen_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """_doc, _fetch_id, _sum, _same: the fetch that each document belongs to, of the same content hash if there is one, else
    the newest of its url. Fetches are reduced by url and hash before anything is joined, so a hot url stays small."""
    own = docs.select("_doc", "_url", F.lower("_hash").alias("_want")).where("_url is not null").distinct()
    by_hash = _fetches(pages).groupBy("url", "_hash").agg(F.max("_fetch").alias("_fetch"))
    newest = by_hash.groupBy("url").agg(F.max("_fetch").alias("_newest"))
    named = by_hash.where("_hash is not null").withColumnsRenamed({"url": "_u", "_fetch": "_exact"})
    got = own.join(newest, own["_url"] == newest["url"]).join(named, (F.col("_url") == F.col("_u")) & (F.col("_want") == named["_hash"]), "left")
    best = F.coalesce("_exact", "_newest")
    return got.select("_doc", best["fetch_id"].alias("_fetch_id"), best["sum"].alias("_sum"), F.col("_exact").isNotNull().alias("_same"))


def _documents(df: DataFrame, document: str, text: str) -> DataFrame:
    url, content_hash = (F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("url", "content_hash"))
    return df.select(F.col(document).cast("bigint").alias("_doc"), F.col(text).alias("_text"), url.alias("_url"), content_hash.alias("_hash")).where("_doc is not null")


def _bodies(pages: DataFrame) -> DataFrame:
    return pages.where("body is not null").select(F.col("fetch_id").alias("_f"), F.xxhash64("body").alias("_s"), F.col("content_type").alias("_type"), F.col("body").alias("_body"))


def sample_documents(df: DataFrame, pages: DataFrame, document: str = "document_id", text: str = "full_text", documents: int = SAMPLE_DOCUMENTS) -> list[tuple[str, Row]]:
    """The bounded sample to learn from: (host, row) of the documents with a page that have the least hash of the id.
    Without any such document, the pages with the least hash of theirs."""
    docs = _documents(df, document, text)
    chosen = chosen_pages(docs, pages).orderBy(F.xxhash64("_doc"), "_doc", "_fetch_id", "_sum").limit(documents).collect()
    if not chosen:
        ids = [r[0] for r in pages.where("body is not null and fetch_id is not null").select("fetch_id").distinct().orderBy(F.xxhash64("fetch_id"), "fetch_id").limit(documents).collect()]
        rows = pages.where(F.col("fetch_id").isin(ids) & F.col("body").isNotNull()).select("fetch_id", "url", "content_type", "body").collect() if ids else []
        best = {r[0]: r for r in sorted(rows, key=lambda r: (r[0], bytes(r[3]), r[2] or "", r[1] or ""))}
        return [(_host(r[1]), (None, bytes(r[3]), r[2], False)) for _, r in sorted(best.items())]
    texts = {}
    for r in docs.where(F.col("_doc").isin([c[0] for c in chosen])).select("_doc", "_text", "_url").collect():
        texts[r[0]] = max(texts.get(r[0], ("", "")), (r[1] or "", r[2] or ""))
    bodies = {}
    for r in _bodies(pages).where(F.col("_f").isin(sorted({c[1] for c in chosen}))).collect():
        bodies[r[0], r[1]] = max(bodies.get((r[0], r[1]), ("", b"")), (r[2] or "", bytes(r[3])))
    return [(_host(texts[d][1]), (texts[d][0], bodies[f, s][1], bodies[f, s][0], same)) for d, f, s, same in chosen if d in texts and (f, s) in bodies]


def _host(url: str | None) -> str:
    return (url or "").split("//")[-1].split("/")[0]


def _with_pages(df: DataFrame, pages: DataFrame | None, document: str, text: str) -> DataFrame:
    """_doc, _text, _type, _body: the documents with their pages, null where there is none."""
    docs = _documents(df, document, text).where("_text is not null")
    if pages is None:
        return spread(docs.select("_doc", "_text", F.lit(None).cast("string").alias("_type"), F.lit(None).cast("binary").alias("_body")), df)
    chosen = small_side(chosen_pages(docs, pages).select("_doc", "_fetch_id", "_sum"), max_rows=1_000_000)
    bodies = _bodies(pages)
    held = bodies.join(chosen, (F.col("_f") == F.col("_fetch_id")) & (F.col("_s") == F.col("_sum"))).select("_doc", "_type", "_body")
    return spread(docs.select("_doc", "_text"), df, "_doc").join(spread(held, df, "_doc"), "_doc", "left").select("_doc", "_text", "_type", "_body")


def furniture_lines(df: DataFrame, model: Furniture, pages: DataFrame | None = None, document: str = "document_id", text: str = "full_text") -> DataFrame:
    """document, line_no of each furniture line; ``pages``: the fetches (fetch_id, url, content_hash, fetched_at,
    content_type, body) that the documents (with url and content_hash) were extracted from."""

    def run(ids: list, texts: list, kinds: list, bodies: list) -> tuple:
        sources = [decoded(b, k) if b is not None else None for k, b in zip(kinds, bodies)]
        found = [(d, n) for k in range(0, len(ids), BATCH) for d, lines in zip(ids[k : k + BATCH], model.many_lines(texts[k : k + BATCH], sources[k : k + BATCH])) for n in lines]
        return [d for d, _ in found], [n for _, n in found]

    return map_columns(_with_pages(df, pages, document, text), run, "_doc bigint, line_no int").distinct().withColumnRenamed("_doc", document)


def main_text(df: DataFrame, model: Furniture, pages: DataFrame | None = None, document: str = "document_id", text: str = "full_text") -> DataFrame:
    """document, main_text: the text without its furniture lines; null texts have none."""

    def run(ids: list, texts: list, kinds: list, bodies: list) -> tuple:
        out = []
        for t, k, b in zip(texts, kinds, bodies):
            drop = set(model.lines(t, decoded(b, k) if b is not None else None))
            out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop).strip("\n"))
        return ids, out

    return map_columns(_with_pages(df, pages, document, text), run, "_doc bigint, main_text string").distinct().withColumnRenamed("_doc", document)


def main_bodies(df: DataFrame, model: Furniture, record: str = "fetch_id", body: str = "body", content_type: str = "content_type") -> DataFrame:
    """record, main_body of each page with a body."""

    def run(ids: list, kinds: list, bodies: list) -> tuple:
        pages = [decoded(b, k) for k, b in zip(kinds, bodies)]
        return ids, [t for k in range(0, len(pages), BATCH) for t in model.bodies(pages[k : k + BATCH])]

    own = df.select(F.col(record).cast("bigint").alias("_id"), F.col(content_type).alias("_type"), F.col(body).alias("_body")).where("_body is not null")
    return map_columns(spread(own, df), run, "_id bigint, main_body string").distinct().withColumnRenamed("_id", record)
