import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import encoding, mixing, near_duplicates, rank_fusion

VOCABULARY = pytest.importorskip("pathlib").Path(encoding.VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary here")


def _brute(question_hits):
    """Leximin by definition over one question's distinct hits."""
    n = len(question_hits)

    def rank(h, k, sign):
        return None if h[k] is None or h[k] != h[k] else 1 + sum(sign * x[k] > sign * h[k] for x in question_hits if x[k] is not None and x[k] == x[k])

    vectors = {h: sorted((n - r + 1 if (r := rank(h, k, s)) else 0) for k, s in ((1, -1), (2, 1), (3, 1))) for h in question_hits}
    return [h[0] for h in sorted(question_hits, key=lambda h: ([-x for x in vectors[h]], h[0]))]


def test_leximin_against_brute_force(spark):
    rng, rows = random.Random(2), []
    for q in range(6):
        for c in range(40):
            rows.append((q, c, rng.choice([None, float("nan"), *([round(rng.random(), 1)] * 6)]), rng.choice([None, rng.random() * 10**q]), rng.choice([None, round(rng.random(), 2)]), "x"))
    rows += rows[:30] + [(None, 1, 0.5, 1.0, 1.0, "x")]
    df = spark.createDataFrame(rows, "question_id long, chunk_id long, dense_distance double, sparse_score double, rrf_score double, final_rank string")
    for size in (100_000, 45, 4):  # at once, one question in parts, all in parts
        got = rank_fusion.leximin_ranking(df, rows_at_once=size).collect()
        assert len(got) == 241
        for q in range(6):
            hits = list(dict.fromkeys(tuple(r[1:5]) for r in rows if r[0] == q))
            hits = list({h[0]: h for h in hits}.values())
            assert [r.chunk_id for r in sorted((r for r in got if r.question_id == q), key=lambda r: r.final_rank)] == _brute(hits)
    assert rank_fusion.leximin_ranking(df.limit(0)).count() == 0


def test_undisputed_comes_first(spark):
    rows = [(1, 1, 0.1, 9.0, 1.0)] + [(1, c, 0.2 + c / 100, None, 0.9) for c in range(2, 12)] + [(1, c, None, 8.0 - c / 10, 0.5) for c in range(12, 20)] + [(2, c, 0.1, 1.0, 1.0) for c in range(3)]
    df = spark.createDataFrame(rows, "question_id long, chunk_id long, dense_distance double, sparse_score double, rrf_score double")
    assert [tuple(r) for r in rank_fusion.undisputed_hits(df).collect()] == [(1, 1)]
    assert rank_fusion.undisputed_hits(df.limit(0)).count() == 0


def _texts():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(55, 200))] for _ in range(30)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for _ in range(rng.randrange(0, 4)):
            w = list(words)
            for _ in range(rng.randrange(0, 14)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice(([], ["edit"], [w[k], "added"], [w[k].upper()]))
            texts.append(rng.choice(("", "  ", "– ")) + ", ".join(w))
    return texts + ["", None, "short text", "x " * 49, "same " * 60, "same " * 60, "é" * 3, " ".join(vocabulary) * 40]


def test_pairs_against_brute_force(spark):
    texts = _texts()
    rows = [(i, i // 2, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:20], "chunk_id long, document_id long, text string, class string")
    source = [(df, "chunk", "chunk_id", "document_id", "text")]
    long = [(i, d, near_duplicates.shingles(t)) for i, d, t, _ in rows if t and len(t.split()) >= 50]
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    linked = {(a, b) for (a, _, x), (b, _, y) in itertools.combinations(long, 2) if likeness(x, y) >= 0.6}
    true = {(a, b) for a, b in linked if a // 2 != b // 2}
    got = [tuple(r) for r in near_duplicates.similar_pairs(source).collect()]
    assert len(got) == len(set(got)) and {(a, b) for _, a, b in got} == true and len(true) > 20
    groups = {r.id: r for r in near_duplicates.groups(source).collect()}
    parent = {i: i for i, _, _ in long}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert set(groups) == set(parent) and all((groups[a].group_id == groups[b].group_id) == (find(a) == find(b)) for a, b in itertools.combinations(parent, 2))
    assert near_duplicates.similar_pairs([(df.limit(0), "chunk", "chunk_id", "document_id", "text")]).count() == 0


def test_few_shingles_are_found(spark):
    cycle = lambda words, n: " ".join((words * n)[:n])
    texts = [cycle(["ha"], n) for n in (60, 70)] + [cycle(["tra", "la", "li"], n) for n in (60, 61, 90)] + [cycle([f"a{i}" for i in range(12)], n) for n in (60, 70)] + [cycle([f"a{i}" for i in range(12)], 60) + " b c d"]
    rows = [(i, i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "chunk_id long, document_id long, text string")
    sets = [near_duplicates.shingles(t) for t in texts]
    true = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    got = {(r.id_a, r.id_b) for r in near_duplicates.similar_pairs([(df, "chunk", "chunk_id", "document_id", "text")]).collect()}
    assert got == true and len(true) >= 6


def test_estimate_is_close():
    rng = random.Random(9)
    for j in (0.3, 0.6, 0.9):
        shared, own = int(600 * j), int(600 * (1 - j) / 2)
        found = []
        for k in range(20):
            common = [f"c{k}-{i}" for i in range(shared)]
            sides = [[*common, *(f"{side}{k}-{i}" for i in range(own))] for side in "ab"]
            words = [[w for s in side for w in (s, s + "x", s + "y")] for side in sides]
            r = near_duplicates.folded(near_duplicates.registers(words, near_duplicates._Hashes()))
            a, b = (set(zip(w, w[1:], w[2:])) for w in words)
            found.append(near_duplicates.estimate(r[:1], r[1:])[0] - len(a & b) / len(a | b))
        assert abs(np.mean(found)) < 0.03 and np.abs(found).max() < near_duplicates.MARGIN
    assert rng is not None


@needs_vocabulary
@given(st.text(alphabet=st.sampled_from("ab 'sZ9é\n\t.,!😀<|> 中½"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_segments_give_the_tokenizers_ids(text):
    t = encoding.tokenizer()
    assert t.encode(text) == t.encoding.encode_ordinary(text) and t.count(text) == len(t.encode(text)) and t.decode(t.encode(text)) == text


@needs_vocabulary
def test_encoding_frames(spark):
    texts = ["Hello world, it's 2024.", "", None, "x" * 5000, "a b  c\n\nd " * 400, "<|endoftext|>", "😀 é " * 900, "one two " * 2000, "one two " * 2000]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(1, "", [1])], "doc_id long, text string, ids array<int>")
    t = encoding.tokenizer()
    for chunk, overlap in ((encoding.CHUNK, encoding.OVERLAP), (64, 16), (64, 1)):
        got = sorted((r.doc_id, list(r.ids)) for r in encoding.encode_corpus(df, chunk=chunk, overlap=overlap).collect())
        assert got == sorted([(i, t.encoding.encode_ordinary(x or "")) for i, x in enumerate(texts)] + [(1, [])])
    back = {r.doc_id: r.text for r in encoding.decode_corpus(encoding.encode_corpus(df)).collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}
    assert encoding.encode_corpus(df.limit(0)).count() == 0


def test_cube_keeps_totals():
    rng = random.Random(1)
    tokens, p = [rng.randrange(1, 900) for _ in range(500)], [0.37] * 500
    flown = mixing.cube_flight(tokens, p, 5)
    assert sum(0 < x < 1 for x in flown) <= 2
    assert sum(flown) == pytest.approx(sum(p)) and sum(x * t for x, t in zip(flown, tokens)) == pytest.approx(sum(x * t for x, t in zip(p, tokens)))
    landed = mixing.cube_landing(tokens, flown)
    assert set(landed) <= {0.0, 1.0} and abs(sum(x * t for x, t in zip(landed, tokens)) - 0.37 * sum(tokens)) < 900
    assert mixing.cube_flight([5] * 40, [0.5] * 40, 1).count(1.0) in (19, 20, 21) and mixing.cube_flight([], [], 1) == []
    drawn = np.mean([mixing.cube_flight([1, 2, 3, 4, 5, 6], [0.25] * 6, s) for s in range(3000)], 0)
    assert np.abs(drawn - 0.25).max() < 0.04  # the probabilities are kept


@needs_vocabulary
def test_mixing(spark):
    rng = random.Random(3)
    text = lambda: "word " * rng.randrange(5, 60)
    rows = [(i, text(), ("A.example", " a.EXAMPLE ", "b.example", "c.example")[i % 4], 0) for i in range(2000)]
    rows += [(5000, None, "a.example", 0), (5001, "", "b.example", 0), (5002, "x", None, 0), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    targets = spark.createDataFrame([("a.example", 0.5, 1), ("b.example", 0.3, 4), ("none.example", 0.2, 2), ("zero.example", 0.0, 3), ("b.example", 0.3, 4)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mixed(df, targets, block=50)
    found = {r.source: r for r in report.collect()}
    assert set(found) == {"a.example", "b.example", "none.example", "zero.example"}
    assert all(abs(r.share_reached - r.share_sought) < 0.002 for r in found.values()) and found["none.example"].share_reached == 0
    kept = mix.collect()
    assert {r.source for r in kept} == {"a.example", "b.example"} and len({r.doc_id for r in kept}) == len(kept)
    assert max(r.copies for r in kept if r.source == "a.example") == 1 and max(r.copies for r in kept) <= 4
    assert {r.share_reached for r in mixing.mixed(df.limit(0), targets)[1].collect()} <= {0.0, None}
    assert mixing.mixed(df, targets.limit(0))[1].count() == 0
