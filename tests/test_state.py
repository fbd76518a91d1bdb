import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import analytics, incremental, snapshots
from corpusmill.streaming import ingest as streaming

T = lambda day, hour=0: dt.datetime(2025, 1, day, hour)
CRAWLS = "fetch_id long, url string, status string, http_status int, content_hash string, body_bytes int, fetched_at timestamp_ntz, arrived_at timestamp_ntz"
EMBEDS = "run_id int, document_id long, content_hash string, skipped boolean, finished_at timestamp_ntz"
RUNS = "run_id int, cutoff_at timestamp_ntz, started_at timestamp_ntz"
DOCUMENTS = "document_id long, url string, run_id string"


def _changed(spark, crawls, embeds, runs, documents=((1, "u", "x"), (2, "v", "x"))):
    f = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return sorted(map(tuple, incremental.changed_documents(f(crawls, CRAWLS), f(documents, DOCUMENTS), f(embeds, EMBEDS), f(runs, RUNS)).collect()))


def test_changed_documents(spark):
    runs = [(1, T(2), T(2, 1)), (2, T(4), T(4, 1)), (3, T(6), T(6, 1)), (1, T(2), T(2, 1))]
    crawls = [(1, "u", "success", 200, "AA", 5, T(1), T(1)), (2, "u", "success", 200, "bb", 5, T(3), T(5)), (3, "v", "error", 500, "cc", 5, T(1), T(1)), (4, "v", "success", 200, None, 5, T(1), T(1)), (1, "u", "success", 200, "AA", 5, T(1), T(1)), (9, None, "success", 200, "aa", 5, T(1), T(1)), (10, "w", "success", 200, "aa", 5, T(1), T(1))]
    embeds = [(1, 1, "aa", False, T(2, 2)), (2, 1, "bb", True, T(4, 2)), (2, 1, "bb", False, None), (3, None, "x", False, T(1))]
    assert _changed(spark, crawls, embeds, runs) == [(1, 1), (3, 1)]
    assert _changed(spark, [], embeds, runs) == [] and _changed(spark, crawls, [], runs) == [(1, 1), (2, 1), (3, 1)] and _changed(spark, crawls, embeds, []) == []
    assert _changed(spark, crawls, embeds, [(5, T(2), None)]) == [(5, 1)]
    tie = [(1, "u", "success", 200, "a", 5, T(1), T(1)), (2, "u", "success", 200, "b", 5, T(1), T(1))]
    assert _changed(spark, tie, [(1, 1, "b", False, T(1))], [(1, T(2), T(3))]) == []


def test_runs_in_blocks(spark, monkeypatch):
    runs = [(i, T(1 + i // 24, i % 24), T(1 + i // 24, i % 24)) for i in range(40)]
    crawls = [(k, "uv"[k % 2], "success", 200, f"h{k // 3}", 5, T(1, k), T(1, k)) for k in range(20)]
    embeds = [(k, 1 + k % 2, f"H{k // 3}", False, T(1, k)) for k in range(0, 20, 3)]
    whole = _changed(spark, crawls, embeds, runs)
    monkeypatch.setattr(incremental, "RUNS_A_BLOCK", 17)
    assert len(whole) > 5 and _changed(spark, crawls, embeds, runs) == whole


def test_descends_only_where_digests_differ(spark):
    rows = [(i, side, i * 7 + (i == 77 and side == "now")) for i in range(256) for side in ("now", "saved")] + [(300, "now", 5)]
    df = spark.createDataFrame(rows, "leaf long, side string, digest long")
    odd = lambda rows: F.filter(F.array(F.lit("x")), lambda _: incremental._xor(rows, lambda x: F.lit(True)) != 0)
    assert {(r.leaf, *r.found) for r in incremental.descend(df, odd, ["side"], 9, 4).collect()} == {(77, "x"), (300, "x")}


def test_merkle_store(spark, tmp_path):
    store = incremental.MerkleStore(spark, str(tmp_path / "state"))
    frame = lambda rows: spark.createDataFrame(rows, "key long, digest string, leaf int")
    one = frame([(i, f"h{i}", 1) for i in range(500)] + [(None, "x", 1), (999, None, 1), (3, "h3", 1)])
    got = store.changes(one, "key", "digest")
    assert got.rows.count() == 500 and store.version() is None
    store.publish(got, one)
    assert store.changes(one, "key", "digest").rows.count() == 0 and store.output().count() == 503
    two = frame([(i, f"h{i}" if i % 100 else "new", 1) for i in range(1, 502)])
    got = store.changes(two, "key", "digest")
    assert {(r.key, r.change) for r in got.rows.collect()} == {(0, "removed"), (500, "added"), (501, "added"), *((i, "changed") for i in (100, 200, 300, 400))}
    assert got.leaves.count() <= 7 < 2**got.bits / 8  # most leaves are pruned
    store.publish(got, two)
    records = spark.read.parquet(str(tmp_path / "state" / store.version() / "records"))
    assert records.count() < 100 and store.changes(two, "key", "digest").rows.count() == 0
    assert store.changes(frame([]), "key", "digest").rows.count() == 501


def test_merkle_store_survives(spark, tmp_path, monkeypatch):
    store = incremental.MerkleStore(spark, str(tmp_path / "state"))
    frame = lambda rows: spark.createDataFrame(rows, "key long, digest string")
    frame([(1, "a")]).write.parquet(str(tmp_path / "source"))
    source = lambda: spark.read.parquet(str(tmp_path / "source"))
    got = store.changes(source(), "key", "digest")
    with monkeypatch.context() as m:  # lost between writing and the swap
        m.setattr(store, "_context", None)
        with pytest.raises(AttributeError):
            store.publish(got, source())
    assert store.version() is None and store.changes(source(), "key", "digest").rows.count() == 1
    frame([(2, "b")]).write.mode("append").parquet(str(tmp_path / "source"))  # arrives in between: not marked as done
    store.publish(got, source().where("key = 1"))
    assert [tuple(r) for r in store.changes(source(), "key", "digest").rows.collect()] == [(2, "added")]
    one, other = store.changes(source(), "key", "digest"), store.changes(source(), "key", "digest")
    store.publish(one, source())
    with pytest.raises(incremental.Conflict):
        store.publish(other, source())
    monkeypatch.setattr(incremental, "KEPT_VERSIONS", 2)
    for n in range(3):  # all leaves anew once there are too many versions
        frame([(10 + n, "c")]).write.mode("append").parquet(str(tmp_path / "source"))
        got = store.changes(source(), "key", "digest")
        assert got.rows.count() == 1
        store.publish(got, source())
    assert len(store._commit()[1]["versions"]) <= 2 and store.changes(source(), "key", "digest").rows.count() == 0


def test_upsert_and_replace(spark):
    stored = spark.createDataFrame([("u", "A", T(1), False), ("v", "B", T(1), True)], "url string, content_hash string, fetched_at timestamp_ntz, is_active boolean")
    fetched = spark.createDataFrame([("u", "c", T(2)), ("v", "b", T(2)), ("w", "d", T(2))], "url string, content_hash string, fetched_at timestamp_ntz")
    got = {r.url: (r.content_hash, r.is_active, r.change) for r in snapshots.upsert_documents(stored, fetched).collect()}
    assert got == {"u": ("c", False, "changed"), "v": ("b", True, "refreshed"), "w": ("d", True, "inserted")}
    chunks = spark.createDataFrame([(100, 1, 0, "old"), (101, 1, 1, "old"), (200, 2, 0, "keep")], "chunk_id long, document_id long, ordinal int, text string")
    fresh = spark.createDataFrame([(1, 0, "new")], "document_id long, ordinal int, text string")
    changed = spark.createDataFrame([(1,)], "document_id long")
    assert {(r.chunk_id, r.text) for r in snapshots.replace_chunks(chunks, fresh, changed).collect()} == {(100, "new"), (200, "keep")}
    assert [tuple(r) for r in snapshots.excess_ordinals(chunks, spark.createDataFrame([(1, 1)], "document_id long, n_chunks int")).collect()] == [(1, 1)]
    docs, left = snapshots.deactivate(spark.createDataFrame([(1, True, "h"), (2, True, "h")], "document_id long, is_active boolean, embedded_hash string"), chunks, changed)
    assert {tuple(r) for r in docs.collect()} == {(1, False, None), (2, True, "h")} and left.count() == 1


def test_publish_swaps(spark, tmp_path):
    folder = str(tmp_path / "s")
    assert snapshots.current(spark, folder) is None
    for version, n in (("v1", 2), ("v2", 3)):
        snapshots.publish(spark.range(n), folder, version)
        assert snapshots.current(spark, folder).count() == n
    with pytest.raises(Exception):
        snapshots.publish(spark.range(9), folder, "v2")
    assert snapshots.current(spark, folder).count() == 3


def test_reports(spark):
    q = spark.createDataFrame([(i, "fees" if i < 6 else None, 0.5, i % 2 == 0, T(6 + i % 2)) for i in range(10)], "question_id long, topic_label string, retrieval_confidence float, was_refused boolean, asked_at timestamp_ntz")
    got = {r.topic: (r.size, r.refusal_rate) for r in analytics.weekly_trends(q).collect()}
    assert got == {"fees": (6, 0.5), "unknown": (4, 0.5)}
    assert [r.topic for r in analytics.k_anonymous(q).collect()] == ["fees"]
    facts = spark.createDataFrame([("k", "1", 1), ("k", "2", 2), ("s", "1", 1), ("s", "1", 2), ("o", "1", 1), ("o", "2", 1), ("n", None, 1)], "key string, value string, source int")
    assert [tuple(r) for r in analytics.conflicts(facts, ["key"], "value", "source").collect()] == [("k", 2, 2, ["1", "2"])]
    answers = spark.createDataFrame([("A [1]. B [2].", 2), ("A [3].", 2), ("No mark.", 2)], "answer string, n_chunks int")
    assert [(r.all_resolve, r.uncited) for r in analytics.citation_validity(answers).collect()] == [(True, 0), (False, 0), (False, 1)]
    assert spark.range(1).select(analytics.support_areas(F.lit("anxiety and debt"))).first()[0] == ["health", "hardship"]
    text = spark.createDataFrame([(1, "Due 3 May: $1,200 on 2025-01-02 and a GPA of 3.5; 2025-01-02"), (2, None)], "document_id long, t string")
    assert {(r.kind, r.value, r.n) for r in analytics.fact_candidates(text, "document_id", "t").collect()} == {("date", "2025-01-02", 2), ("amount", "$1,200", 1), ("gpa", "GPA of 3.5", 1), ("deadline", "Due 3 May", 1)}


def test_gold_set(spark, tmp_path):
    (tmp_path / "gold.jsonl").write_text("\n".join(['{"id":"a","family":"factual","question":"q","expected":"7 May","must_cite":["u"]}', '{"id":"b","family":"refusal","question":"q","expected":"x"}', '{"id":"c","family":"factual","question":"q","expected":"y","must_cite":["u"]}', '{"family":"factual"}']))
    gold = analytics.read_gold(spark, str(tmp_path / "gold.jsonl"))
    answers = spark.createDataFrame([("a", "It is 7 MAY.", False, ["u", "v"], 1.0), ("b", "", True, [], 2.0), ("zz", "", True, [], 9.0)], "id string, answer string, refused boolean, cited array<string>, latency_s double")
    m = analytics.evaluation(analytics.judged(gold, answers)).first()
    assert (m.n, m.accuracy, m.citation_validity, m.wrong_answer_rate, m.correct_refusal, m.false_refusal) == (3, 0.5, 0.5, round(1 / 3, 6), 1.0, 0.0)


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, T(1, 1)), (1, T(1, 1)), (2, T(1, 2)), (9, T(9))], "user_id long, ts timestamp_ntz")
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = streaming.request_windows(source).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r.user_id, r.n_requests) for r in spark.table("w").collect()} >= {(1, 2), (2, 1)}
    body = b"<main><p>" + b"word " * 120 + b"</p></main>"
    pages = spark.createDataFrame([("u", "h", "text/html", body)], "url string, content_hash string, content_type string, body binary")
    for _ in range(2):
        pages.write.mode("append").parquet(str(tmp_path / "pages"))
        stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "pages"))
        streaming.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/chunks")).count() == 1
    assert {r.state for r in spark.read.parquet(str(tmp_path / "out/documents")).collect()} == {"ok", "unchanged"}
