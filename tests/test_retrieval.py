import pytest
from pyspark.sql import functions as F

from corpusmill.operators import confidence, search

AXES = [[1.0 if i == j else 0.0 for j in range(4)] for i in range(4)]


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = spark.createDataFrame([(1, 10, 0, "A", None, "course CP104 is hard", AXES[0]), (2, 10, 1, "A", "x", "fees and CP104 fees", AXES[1]), (3, 11, 0, None, None, "CP104 inactive", AXES[0]), (4, 12, 0, "", None, "", [0.0] * 4), (5, 12, 1, "", None, None, None)],
                                   "chunk_id long, document_id long, ordinal int, heading_path string, url_anchor string, text string, embedding array<float>")
    documents = spark.createDataFrame([(10, "u10", "t", True), (11, "u11", "t", False), (12, "u12", None, True)], "document_id long, url string, title string, is_active boolean")
    return chunks, documents


def test_hybrid(spark, corpus):
    asked = spark.createDataFrame([(1, "cp104", AXES[0]), (2, "  ", AXES[0]), (3, "fees CP104", AXES[2]), (4, "nothing", None)], "question_id long, text string, vector array<float>")
    got = search.hybrid_search(*corpus, asked).orderBy("question_id", "rank").collect()
    one = [r for r in got if r.question_id == 1]
    assert {r.question_id for r in got} == {1, 3}
    assert one[0].chunk_id == 1 and one[0].dense_distance < 1e-6 and [r.rank for r in one] == list(range(1, len(one) + 1)) and all(r.document_id != 11 for r in got)
    assert [r.chunk_id for r in got if r.question_id == 3][0] == 2
    cover = search.sparse_topk(corpus[0], asked, rank="cover").collect()
    assert {(r.question_id, r.chunk_id) for r in cover} == {(1, 1), (1, 2), (1, 3), (3, 2)}
    assert search.dense_topk(corpus[0], asked.limit(0)).count() == 0


def test_dense_matches_expression(spark, corpus):
    a = search.dense_topk(corpus[0], spark.createDataFrame([(7, [1.0, 2.0, 0.0, 0.0])], "question_id long, vector array<float>"), k=2).collect()
    b = corpus[0].select("chunk_id", search.cosine_distance(F.col("embedding"), F.array(*map(F.lit, [1.0, 2.0, 0.0, 0.0]))).alias("d")).where("d is not null").orderBy("d", "chunk_id").limit(2).collect()
    assert [(r.chunk_id, r.dense_distance) for r in a] == [(r.chunk_id, round(r.d, 6)) for r in b]


def test_rrf(spark):
    dense = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "question_id long, chunk_id long, dense_rank int")
    sparse = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "question_id long, chunk_id long, sparse_rank int")
    got = {r.chunk_id: (r.rrf_score, r.rank) for r in search.fuse(dense, sparse).collect()}
    assert got == {1: (1 / 61, 2), 2: (1 / 62 + 1 / 61, 1), 3: (1 / 62, 3)}


def test_confidence(spark):
    hits = [(1, i + 1, 0.05 + 0.02 * i) for i in range(8)] + [(2, i + 1, 0.75 + 0.01 * i) for i in range(8)] + [(3, 1, None)] + [(4, 1, 0.05), (4, 2, 0.5)] + [(5, 1, 0.2)] + [(7, 1, None), (7, 2, 0.5), (7, 3, 0.6), (7, 4, 0.6), (7, 5, 0.4), (7, 6, 0.5), (7, 7, 0.5), (7, 8, 0.5)]
    h = spark.createDataFrame(hits, "question_id long, rank int, dense_distance double")
    q = spark.createDataFrame([(i, "osap") for i in range(1, 8)], "question_id long, text string")
    got = {r.question_id: r for r in confidence.confidence(q, h).collect()}
    assert not got[1].should_refuse and got[2].should_refuse and got[3].should_refuse and got[3].top1_similarity == 0
    assert got[4].top1_top5_gap == 0.45 and got[5].top1_top5_gap == 0 and got[6].score == 0 and got[6].should_refuse
    assert got[7].score == -0.8
    assert {r.question_id: r.top1_top5_gap for r in confidence.confidence(q, h, clamp_gap=True).collect()}[7] == 0
    assert {r.question_id: r.should_refuse for r in confidence.confidence(q, h, threshold=0.0).collect()} == {1: False, 2: False, 3: False, 4: False, 5: False, 6: True, 7: True}
    told = {r.question_id: r for r in confidence.refusals(q, h).collect()}
    assert set(told) == {2, 3, 6, 7} and told[6].topic == "financial" and told[6].office_url in told[6].message


def test_ask_batch(spark):
    from corpusmill.operators.encode import embed
    from corpusmill.plans.ask import ask_batch

    chunks = embed(spark.createDataFrame([(i, 1, i, "", None, t) for i, t in enumerate(("tuition fees are due in May", "rivers and bridges", "exam dates"))], "chunk_id long, document_id long, ordinal int, heading_path string, url_anchor string, text string"))
    documents = spark.createDataFrame([(1, "u", "t", True)], "document_id long, url string, title string, is_active boolean")
    asked = spark.createDataFrame([(1, "tuition fees are due in May"), (2, "unrelated words only"), (3, " ")], "question_id long, text string")
    hits, refused = ask_batch(chunks, documents, asked)
    assert {r.question_id for r in hits.collect()} == {1} and {r.question_id for r in refused.collect()} == {2, 3}


def test_dense_with_repeats_and_index(spark):
    import numpy as np

    rng = np.random.RandomState(0)
    v = rng.randn(600, 8).astype(float)
    rows = [(i, v[i].tolist()) for i in range(600)] + [(i, v[i].tolist()) for i in range(0, 600, 7)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 600, 50)], "question_id long, vector array<float>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    exact = {q: set(np.argsort(1 - unit @ unit[q], kind="stable")[:5]) for q in range(0, 600, 50)}
    got = {}
    for r in search.dense_topk(chunks, asked, k=5).collect():
        got.setdefault(r.question_id, set()).add(r.chunk_id)
    assert got == exact
    centres = search.train_cells(chunks, "chunk_id", "embedding", cells=12)
    probes = search.probes_for(chunks, asked, centres, k=5, recall=0.95)
    found = search.dense_topk(search.with_cells(chunks, centres), asked, k=5, centres=centres, probes=probes).collect()
    assert probes <= 12 and sum(r.chunk_id in exact[r.question_id] for r in found) >= 0.9 * 5 * len(exact)
    every = search.dense_topk(chunks, asked, k=5, centres=centres, probes=12).collect()
    assert {(r.question_id, r.chunk_id) for r in every} == {(q, c) for q, s in exact.items() for c in s}
    assert search.dense_topk(chunks.limit(0), asked, k=5).count() == 0


def test_stored_postings_give_the_same(spark, corpus):
    asked = spark.createDataFrame([(1, "fees CP104"), (2, "the of")], "question_id long, text string")
    for analyzer in ("simple", "english"):
        kept = search.postings(corpus[0], analyzer)
        one, two = (sorted(map(tuple, search.sparse_topk(corpus[0], asked, rank="cover", analyzer=analyzer, stored=s).collect())) for s in (None, kept))
        assert one == two and [r[1] for r in one] == [2]
