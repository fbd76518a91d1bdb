"""Subject area of each document (problem 10).

Weighted subject terms are matched by one multi-pattern automaton over the normalised text (lower case, plural s folded,
small words left out; a term is one or two words, or a word's beginning). The terms are a curated list
(``subject_terms.txt``, a parameter) completed by those that labelled documents show: words and pairs of words that
stand in documents of one subject nearly always, learnt from a bounded sample of labels (``LABELLED`` documents).

A term's weight is lowered by its frequency in all documents (rarity), and by how seldom the other terms of its
documents agree with it (consistency over all documents: a word that is used in every context says little about its
subject). The terms of a sentence add up to at most 1 for a
subject; a subject far behind the sentence's best one gets nothing of it. A subject is assigned from ``min_score``
sentences on, or, normalised by length, from ``min_share`` of the document's sentences on. Both thresholds are calibrated
in the run on labelled documents that gave no terms; without labels the defaults hold.

Term statistics cover all documents; there are as many of them as terms. Defined cases: null, empty and blank texts
and texts without any term have no subject; repeated rows count once; unknown languages are matched like others; labels
of unknown documents or null subjects are ignored.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.arrow import map_columns
from corpusmill.session import cut

MIN_SCORE = 1.6
MIN_SHARE = 0.45
COMMON_SHARE = 0.1
BEHIND = 0.6
AGREED = 0.6
LABELLED = 4_000
LEAST_LABELS = 4
PURITY = 0.65

_SENTENCE = re.compile(r"(?<=[.!?…;])\s+|\n+")
_PLURAL = re.compile(r"(?<=\w\w[^\Ws])(?:['’]?s)(?= )")
_OTHER = re.compile(r"[\W_]+|\d\w*")
_SMALL = frozenset(
    "and or of the in on at to by for with from a an as is are be its it de des du la le les el los las lo und der die das den dem von zu im am mit al un une au aux en para por con del y e o et ou que qui dans sur s l d".split()
)
Learned = list[tuple[str, str, float]]


@functools.lru_cache(maxsize=50_000)
def _folded(word: str) -> str:
    return _PLURAL.sub("", word + " ").strip()


def _stem(word: str) -> str:
    """The beginning that a starred word stands for, without an s that folding would take away."""
    bare = word.rstrip("*")
    return bare[:-1] if len(bare) > 4 and bare.endswith("s") else bare


def words_of(text: str) -> list[str]:
    """Words that may be terms: lower-cased, plural s folded, without small words, numbers and marks."""
    return [_folded(w) for w in _OTHER.sub(" ", text.lower().replace("’", "'")).split() if w not in _SMALL]


def sentences_of(text: str | None) -> list[list[str]]:
    flat = text or ""
    flat = flat if flat.isascii() else unicodedata.normalize("NFKC", flat)
    return [w for w in map(words_of, _SENTENCE.split(flat)) if w]


class Terms:
    """The terms of a file's lines ``subject | language | weight | term; term``, and learnt ones."""

    def __init__(self, text: str, learned: Learned = ()) -> None:
        self.subject: list[str] = []
        self.weight: list[float] = []
        self.patterns: list[str] = []
        self.automaton = ahocorasick.Automaton()
        known: dict[str, list[int]] = defaultdict(list)

        def add(pattern: str, subject: str, weight: float) -> None:
            known[pattern].append(len(self.subject))
            self.patterns.append(pattern)
            self.subject.append(subject)
            self.weight.append(weight)

        shown = {(term, subject) for term, subject, _ in learned}
        against = {term for term, _, _ in learned}
        for line in text.splitlines():
            if line.startswith("#") or line.count("|") != 3:
                continue
            subject, _, weight, terms = (x.strip() for x in line.split("|"))
            for term in filter(None, (t.strip() for t in terms.split(";"))):
                own = " ".join(words_of(term)) if not term.endswith("*") else " ".join([*words_of(" ".join(term.split()[:-1])), _stem(term.split()[-1])])
                if own and not (own in against and (own, subject) not in shown):  # labels overrule the list
                    add(f" {own}" if term.endswith("*") else f" {own} ", subject, float(weight))
        for term, subject, weight in learned:
            add(f" {term} ", subject, weight)
        for pattern, numbers in known.items():
            self.automaton.add_word(pattern, tuple(numbers))
        if known:
            self.automaton.make_automaton()

    def in_sentences(self, sentences: list[list[str]]) -> list[list[int]]:
        """The terms of each sentence that has some."""
        if not self.subject:
            return []
        found = [self._longest(f" {' '.join(s)} ") for s in sentences]
        return [f for f in found if f]

    def _longest(self, sentence: str) -> list[int]:
        """The terms in a sentence; one inside a longer one doesn't count."""
        spans = [(end - len(self.patterns[numbers[0]]) + 1, end + 1 - self.patterns[numbers[0]].endswith(" "), numbers) for end, numbers in self.automaton.iter(sentence)]
        spans.sort(key=lambda x: (x[0], -x[1]))
        out, reach = set(), -1
        for _, end, numbers in spans:
            if end > reach:
                out.update(numbers)
                reach = end
        return sorted(out)

    def in_text(self, text: str | None) -> tuple[int, list[list[int]]]:
        """(sentences with words, the terms of each sentence that has some)."""
        sentences = sentences_of(text)
        return len(sentences), self.in_sentences(sentences)


def listed(path: str | None = None) -> str:
    """The curated terms."""
    if path:
        with open(path, encoding="utf-8") as f:
            return f.read()
    from importlib.resources import files

    return files("corpusmill.llm").joinpath("subject_terms.txt").read_text(encoding="utf-8")


def learn(labelled: list[tuple[str, set[str]]]) -> Learned:
    """(term, subject, weight) of words and pairs of words that nearly only documents of one subject hold."""
    total, by_subject, prior = Counter(), Counter(), Counter()
    for text, subjects in labelled:
        own = {t for s in sentences_of(text) for t in (*(w for w in s if len(w) > 2), *(f"{a} {b}" for a, b in zip(s, s[1:])))}
        total.update(own)
        for subject in subjects:
            prior[subject] += 1
            by_subject.update((t, subject) for t in own)
    out = []
    for (term, subject), n in by_subject.items():
        expected = prior[subject] / max(1, len(labelled))
        purity = (n + 2 * expected) / (total[term] + 2)
        if n >= LEAST_LABELS and purity >= PURITY and purity >= 2 * expected:
            out.append((term, subject, round(min(1.0, purity), 3)))
    return sorted(out)


def rarities(document_counts: dict[int, int], documents: int) -> dict[int, float]:
    """Rarity by term: 1 in up to ``COMMON_SHARE`` of the documents, less beyond (0.6 in three times as many)."""
    return {i: min(1.0, math.log1p(documents / n) / math.log1p(1 / COMMON_SHARE)) for i, n in document_counts.items() if n}


def consistencies(counts: dict[int, tuple[int, int]]) -> dict[int, float]:
    """Factor by term from (documents that hold it, those whose terms agree): 1 from ``AGREED`` of them on."""
    return {i: min(1.0, (hits + 1) / (n + 1) / AGREED) ** 3 for i, (n, hits) in counts.items()}


def scores_of(table: Terms, rarity: dict[int, float], sentences: list[list[int]]) -> dict[str, float]:
    """Score by subject: over the sentences, how surely each is about it."""
    scores: dict[str, float] = defaultdict(float)
    for found in sentences:
        doubt: dict[str, float] = defaultdict(lambda: 1.0)
        for i in found:
            doubt[table.subject[i]] *= 1 - min(0.95, table.weight[i] * rarity.get(i, 1.0))
        best = 1 - min(doubt.values())
        for s, d in doubt.items():
            if 1 - d >= BEHIND * best:
                scores[s] += 1 - d
    return scores


def assigned(scores: dict[str, float], total: int, min_score: float, min_share: float) -> dict[str, float]:
    return {s: x for s, x in scores.items() if x >= min_score or x >= min_share * total}


def calibrate(scored: list[tuple[dict[str, float], int, set[str]]]) -> tuple[float, float, float]:
    """(min_score, min_share, F1) that agree best with labelled documents: (scores, sentences, subjects)."""
    best = (0.0, MIN_SCORE, MIN_SHARE)
    for score in (0.9, 1.1, 1.3, 1.5, 1.7, 1.9, 2.3, 2.7, 3.5):
        for share in (0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9):
            hit = wrong = missed = 0
            for scores, total, goal in scored:
                got = set(assigned(scores, total, score, share))
                hit, wrong, missed = hit + len(got & goal), wrong + len(got - goal), missed + len(goal - got)
            best = max(best, (2 * hit / max(1, 2 * hit + wrong + missed), score, share))
    return best[1], best[2], best[0]


def labelled_sample(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", most: int = LABELLED) -> list[tuple[object, str, set[str]]]:
    """The bounded sample of labelled rows: (id, text, subjects) of the documents with the least hash of the id."""
    own = labels.where(f"{doc} is not null and subject is not null").groupBy(F.col(doc).alias("_doc")).agg(F.collect_set("subject").alias("_subjects"))
    few = {r[0]: set(r[1]) for r in own.orderBy(F.xxhash64("_doc"), "_doc").limit(most).collect()}
    if not few:
        return []
    named = docs.sparkSession.createDataFrame([(d,) for d in few], f"_doc {dict(labels.dtypes)[doc]}")
    rows = docs.select(F.col(doc).alias("_d"), F.col(text).alias("_text")).join(F.broadcast(named), F.col("_d") == F.col("_doc"), "left_semi")  # at most LABELLED ids
    texts: dict = {}
    for r in rows.where("_text is not null").collect():
        texts[r[0]] = max(r[1], texts.get(r[0], ""))
    return [(d, texts[d], few[d]) for d in sorted(texts, key=lambda d: (zlib.crc32(str(d).encode()), str(d)))]


def document_subjects(df: DataFrame, labels: DataFrame | None = None, doc: str = "doc_id", text: str = "text", path: str | None = None, min_score: float | None = None, min_share: float | None = None) -> DataFrame:
    """doc, subject, score: one row for each subject of a document; ``labels``: doc, subject of labelled examples."""
    sample = labelled_sample(df, labels, doc, text) if labels is not None else []
    teach, judge = [x for i, x in enumerate(sample) if i % 3], [x for i, x in enumerate(sample) if i % 3 == 0]
    listing, learned = listed(path), learn([(t, s) for _, t, s in teach])

    def match(docs: list, texts: list) -> tuple:
        table = _table(listing, tuple(learned))
        out: tuple = ([], [], [], [])
        for t in texts:
            total, found = table.in_text(t)
            scores = scores_of(table, {}, found)
            agreed = {s for s, x in scores.items() if x >= 0.5 * max(scores.values())}
            held = {i for f in found for i in f}
            for column, value in zip(out, (total, found, sorted(held), sorted(i for i in held if table.subject[i] in agreed))):
                column.append(value)
        return (docs, *out)

    own = df.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).where("_doc is not null and trim(_text) <> ''")
    kind = {f.name: f.dataType.simpleString() for f in own.schema}["_doc"]
    matched = cut(map_columns(own, match, f"_doc {kind}, _total int, _sentences array<array<int>>, _held array<int>, _agreed array<int>"))
    tally = lambda c: matched.select(F.explode(c).alias("term")).groupBy("term").agg(F.count("*").alias(c))
    counts = {r.term: (r["_held"], r["_agreed"] or 0) for r in tally("_held").join(tally("_agreed"), "term", "left").collect()}  # one row a term
    consistency, rare = consistencies(counts), rarities({i: n for i, (n, _) in counts.items()}, matched.count())
    rarity = {i: x * consistency[i] for i, x in rare.items()}
    table = Terms(listing, learned)
    if judge and (min_score is None or min_share is None):
        scored = [(scores_of(table, rarity, found), total, goal) for (total, found), goal in ((table.in_text(t), s) for _, t, s in judge)]
        fitted = calibrate(scored)
    else:
        fitted = (MIN_SCORE, MIN_SHARE, 0.0)
    least, share = fitted[0] if min_score is None else min_score, fitted[1] if min_share is None else min_share

    def score(docs: list, totals: list, sentences: list) -> tuple:
        table = _table(listing, tuple(learned))
        rows = [(d, s, x) for d, n, found in zip(docs, totals, sentences) for s, x in assigned(scores_of(table, rarity, found), n, least, share).items()]
        return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]

    scored = map_columns(matched.where("size(_sentences) > 0").select("_doc", "_total", "_sentences"), score, f"_doc {kind}, subject string, score double")
    return scored.groupBy(F.col("_doc").alias(doc), "subject").agg(F.max("score").alias("score"))


@functools.lru_cache(maxsize=2)
def _table(listing: str, learned: tuple) -> Terms:
    """Built once a worker."""
    return Terms(listing, list(learned))


def composition(df: DataFrame, labels: DataFrame | None = None, **parameters: object) -> DataFrame:
    """subject, n_documents: how many documents are about each subject."""
    return document_subjects(df, labels, **parameters).groupBy("subject").agg(F.count("*").alias("n_documents"))


def agreement(spark: SparkSession, df: DataFrame, labels: DataFrame) -> DataFrame:
    """what, n, precision, recall against the labels that were kept out of the learning (some of them are wrong)."""
    judge = {d: s for i, (d, _, s) in enumerate(labelled_sample(df, labels)) if i % 3 == 0}
    found: dict = defaultdict(set)
    named = spark.createDataFrame([(d,) for d in judge], "doc_id bigint")
    for r in document_subjects(df, labels).join(F.broadcast(named), "doc_id", "left_semi").collect():  # at most a third of LABELLED
        found[r.doc_id].add(r.subject)
    hit, got, goal = sum(len(found[d] & s) for d, s in judge.items()), sum(len(found[d]) for d in judge), sum(map(len, judge.values()))
    return spark.createDataFrame([("held-out labels", len(judge), hit / max(1, got), hit / max(1, goal))], "what string, n bigint, precision double, recall double")
