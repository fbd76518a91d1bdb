import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import fulltext, redaction, routing
from corpusmill.operators import chunking, encode, extract, quality
from corpusmill.plans.pipeline import ingest, summary_text

PAGE = b"""<html><head><title>Fees &amp; dates</title></head><body><nav>Menu</nav><main><p>Intro.</p><h2 id="registrar">Registrar</h2><p>One<br>two</p><ul><li>a</li><li>b</li></ul>
<h3 id="fees">Fees</h3><p>Pay   now.</p><h2>Empty</h2></main><footer>Foot</footer></body></html>"""


def test_sections_and_offsets():
    title, text, blocks = extract.extract_document(PAGE, "text/html; charset=utf-8")
    assert title == "Fees & dates"
    assert [(b[1], b[2]) for b in blocks] == [("", None), ("Registrar", "registrar"), ("Registrar > Fees", "fees")]
    assert blocks[1][0] == "One\ntwo\n\na\n\nb"
    assert all(text[b[3] : b[4]] == b[0] for b in blocks) and "Menu" not in text and "Foot" not in text
    assert extract.extract_document(b"", "text/html") is None and extract.extract_document(b"x", "image/png") is None and extract.extract_document(b"x", None) is None


def test_pdf_pages_keep_their_numbers():
    _, text, blocks = extract.extract_document(b"%PDF", "application/pdf", lambda b: ["first", " ", "third"])
    assert [b[1] for b in blocks] == ["Page 1", "Page 3"] and blocks[0][3] < blocks[1][3]


def test_markdown_sections():
    got = extract.markdown_sections("pre\n# A\nx\n## B\ny\n# C\n", {"b": "anchor-b"})
    assert got == [("pre", "", None), ("x", "A", None), ("y", "A > B", "anchor-b")]


def test_markdown_mode():
    shown = lambda page: "# Fees & dates\nIntro.\n## Registrar\nOne two\n### Fees\nPay now."
    title, text, blocks = extract.extract_document(PAGE, "text/html", to_markdown=shown)
    assert [(b[1], b[2]) for b in blocks] == [("Fees & dates", None), ("Fees & dates > Registrar", "registrar"), ("Fees & dates > Registrar > Fees", "fees")]
    assert all(text[b[3] : b[4]] == b[0] for b in blocks)
    plain = extract.extract_document(PAGE, "text/html", to_markdown=lambda page: "no headings kept")  # the page's own are better
    assert [b[1] for b in plain[2]] == ["", "Registrar", "Registrar > Fees"]
    assert extract.extract_document(b"# A\nx", "text/markdown") == ("A", "x", [("x", "A", None, 0, 1)])
    assert extract.extract_document(b"<main><h1>Top</h1><p>x</p></main>", "text/html")[0] == "Top"


def test_stems_of_the_published_sample():
    sample = {
        "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist", "consistent": "consist", "consistently": "consist",
        "consisting": "consist", "consists": "consist", "consolation": "consol", "consolations": "consol", "console": "consol", "consolidate": "consolid", "consolidated": "consolid", "consoling": "consol", "consolingly": "consol",
        "knack": "knack", "knackeries": "knackeri", "knacks": "knack", "knave": "knave", "knavish": "knavish", "kneaded": "knead", "kneel": "kneel", "kneeled": "kneel", "kneels": "kneel", "knees": "knee", "knell": "knell", "knightly": "knight", "knitting": "knit", "knives": "knive", "knocker": "knocker", "knots": "knot",
        "running": "run", "hoped": "hope", "hopping": "hop", "dying": "die", "news": "news", "skies": "sky", "happily": "happili", "generously": "generous", "communism": "communism", "relational": "relat", "fees": "fee", "registered": "regist", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "kiwis": "kiwi", "youth": "youth", "say": "say", "by": "by", "cry": "cri", "exceed": "exceed", "école": "école",
    }
    assert {w: fulltext.stem(w) for w in sample} == sample


def test_plain_text_in_the_jvm(spark):
    for fragment in ("<p>a  b</p><p>c<br/>d</p>", "x <b>y</b>\n z", "<ul><li>1</li><li>2</li></ul>", "", "   "):
        got = spark.range(1).select(extract.plain_text_expr(F.lit(fragment))).first()[0]
        assert got == extract.plain_text(fragment)


def _tiles(blocks, limit=350):
    full = "\n\n".join(b[0] for b in blocks)
    chunks = chunking.chunk_document(blocks)
    for text, _, a, b, _, n in chunks:
        assert full[a:b] == text and n == chunking.count_tokens(text) <= limit
    return full, chunks


def _blocks(*parts):
    place, out = 0, []
    for text, path in parts:
        out.append((text, path, None, place))
        place += len(text) + 2
    return out


def test_chunks_cover_and_fit():
    sentence = "Students should meet an advisor before they change their program of study. "
    assert len(_tiles(_blocks((sentence * 100, "A")))[1]) > 1
    full, chunks = _tiles(_blocks(("CP104/" * 1500, "A")))
    assert "".join(c[0] for c in chunks) == full
    full, chunks = _tiles(_blocks((" ".join(["tuition"] * 800), "A")))
    assert "".join(c[0] for c in chunks) == full
    _tiles(_blocks(("\n".join(f"line{i}" for i in range(400)), "A")))
    full, chunks = _tiles(_blocks(("\n\n".join(" ".join(f"w{i}x{j}" for j in range(120)) + "." for i in range(5)), "A")))
    assert chunks[0][2] == 0 and chunks[-1][3] == len(full)


def test_overlap_is_whole_sentences():
    sentences = [f"Sentence number {i} says something about fees and dates today." for i in range(200)]
    _, chunks = _tiles(_blocks((" ".join(sentences), "A")))
    for a, b in zip(chunks, chunks[1:]):
        shared = a[3] - b[2]
        assert shared > 0 and chunking.count_tokens(b[0][:shared]) <= 50 and b[0].startswith("Sentence")


def test_small_sections_join_only_relatives():
    joined = chunking.chunk_document(_blocks(("short", "Fees > A"), ("also short", "Fees > B")))
    assert [(c[0], c[1]) for c in joined] == [("short\n\nalso short", "Fees")]
    assert len(chunking.chunk_document(_blocks(("short", "Fees"), ("also short", "Housing")))) == 2
    assert len(chunking.chunk_document(_blocks(("short", "Fees"), ("child", "Fees > X")))) == 1
    assert [c[0] for c in chunking.chunk_document(_blocks((" ", "A"), ("a", "A")))] == ["a"]
    assert chunking.chunk_document([]) == []
    many = _blocks(*[(f"Item {i} is due soon.", "List > Part") for i in range(120)])
    text = "\n".join(c[0] for c in _tiles(many)[1])
    assert all(f"Item {i} is" in text for i in range(120))


def test_chunk_blocks_frame(spark):
    df = spark.createDataFrame([(1, 1, "world", None, "x", 7), (1, 0, "hello", "", None, 0), (1, 0, "hello", "", None, 0), (2, 0, None, None, None, 0), (None, 0, "x", "", None, 0)], "document_id long, block_no int, text string, heading_path string, anchor_id string, char_start int")
    got = chunking.chunk_blocks(df).collect()
    assert [(r.document_id, r.ordinal, r.text, r.url_anchor) for r in got] == [(1, 0, "hello\n\nworld", "x")]


def test_quality_gate(spark):
    good = "word " * 100
    texts = [good, "", "   ", None, "two words", "nav " * 32] + [good + p.upper() for p in quality.CONSENT_PHRASES[:4]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(quality.is_usable(F.col("t"))).collect()] == [True] + [False] * 9


def test_masks_are_the_same_in_the_jvm(spark):
    import random

    rng = random.Random(3)
    parts = ["josé@uni.example", "jürgen.müller@uni.example", "a_b@почта.example", "é", "ß", "_", " ", ".", "@", "416-555-0199", "(416) 555 0199", "123456789", "١٢٣٤٥٦٧٨٩", "K7L 3N6", "k7l-3n6", "x\u0301", "\xa0", "\x1f", "中", "+1 ", "ſ1ſ 1ſ1", "⅓", "-", "tel:"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(3000)] + ["", " "]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = [r.m for r in df.select(redaction.mask(F.col("t")).alias("m")).collect()]
    plain = lambda t: __import__("re").sub(r"⟨([A-Z_]+)_\d+⟩", r"⟨\1⟩", redaction.redact_text(t)[0])
    assert got[:-1] == [plain(t) for t in texts] and got[-1] is None
    assert "josé" not in got[texts.index(next(t for t in texts if "josé@" in t and "⟨EMAIL⟩" in plain(t)))]


def test_redaction_roundtrip(spark):
    text = "Mail a.b@c.org or call (519) 884-0710, id 123456789, N2L 3C5, CP104 and a.b@c.org"
    masked, kept = redaction.redact_text(text)
    assert "CP104" in masked and "@" not in masked and "123456789" not in masked and "⟨EMAIL_2⟩" in masked
    df = spark.createDataFrame([(1, text), (2, None), (3, "nothing")], "id long, text string")
    got = redaction.redact(df, "id", "text").select("id", redaction.restore(F.col("redacted"), F.col("placeholders"))).collect()
    assert {tuple(r) for r in got} == {(1, text), (2, None), (3, "nothing")}


def test_topics(spark):
    cases = [("where is the co-op office", "coop"), ("my transcript fee", "registrar"), ("OSAP?", "financial"), ("counselling", "wellbeing"), ("wellbeing", "advising"), ("fees", "advising"), ("accessible learning", "accessibility"), ("  ", "advising"), (None, "advising")]
    df = spark.createDataFrame(cases, "q string, t string")
    assert [r[0] for r in df.select(routing.topic_of(F.col("q"))).collect()] == [t for _, t in cases]


def test_analyzers_and_cover_rank():
    assert fulltext.analyze("The Fees, fees!", "simple") == [("the", 1), ("fees", 2), ("fees", 3)]
    assert [t for t, _ in fulltext.analyze("The registered courses were registering", "english")] == ["regist", "cours", "regist"] or [t for t, _ in fulltext.analyze("running courses", "english")] == ["run", "cours"]
    assert fulltext.cover_rank([[1, 5, 9]]) == pytest.approx(0.3)
    assert fulltext.cover_rank([[1], [2]]) == pytest.approx(0.1)
    assert fulltext.cover_rank([[1], [4]]) == pytest.approx(0.1 / 3)
    assert fulltext.cover_rank([[1], []]) == 0 == fulltext.cover_rank([])
    # brute force: minimal extents by trying all pairs
    rng = random.Random(3)
    for _ in range(200):
        p = [sorted(rng.sample(range(1, 30), rng.randrange(1, 5))) for _ in range(3)]
        if len({x for q in p for x in q}) < sum(map(len, p)):
            continue
        covers = [(a, b) for a in range(30) for b in range(a, 30) if all(any(a <= x <= b for x in q) for q in p)]
        least = [c for c in covers if not any(c != d and c[0] <= d[0] and d[1] <= c[1] for d in covers)]
        assert fulltext.cover_rank(p) == pytest.approx(sum(0.1 / (1 + (b - a) - 2) for a, b in least))


def test_encoding_batches_and_retries():
    sizes, waits, fails = [], [], [2]

    def encoder(texts):
        if fails[0]:
            fails[0] -= 1
            raise OSError("busy")
        sizes.append(len(texts))
        return [[float(len(t))] for t in texts]

    got = encode.encode_texts(["x" * i for i in range(70)], encoder, 32, 4, 0.5, waits.append)
    assert sizes == [32, 32, 6] and waits == [0.5, 1.0] and [v[0] for v in got] == list(range(70))
    assert encode.encode_texts([], encoder) == []
    fails[0] = 99
    with pytest.raises(OSError):
        encode.encode_texts(["x"], encoder, sleep=waits.append)


def test_ingest_is_idempotent(spark):
    body = b"<main><h1>T</h1><p>" + b"word " * 120 + b"</p></main>"
    pages = spark.createDataFrame([("u1", "h1", "text/html", body), ("u2", "h2", "application/octet-stream", b"x"), ("u3", "h3", "text/html", b"<p>short</p>"), ("u4", None, "text/html", body), ("u1", "h1", "text/html", body)], "url string, content_hash string, content_type string, body binary")
    first = ingest(pages)
    assert {r.url: r.state for r in first.documents.collect()} == {"u1": "ok", "u2": "extract_skipped", "u3": "quality_rejected"} and first.chunks.count() == 1
    again = ingest(pages, first.documents.where("state = 'ok'").select("url", F.upper("content_hash").alias("embedded_hash")))
    assert {r.state: r.n_documents for r in again.summary.collect()}["unchanged"] == 1 and again.chunks.count() == 0
    assert ingest(pages, first.documents.selectExpr("url", "content_hash as embedded_hash"), force=True).chunks.count() == 1
    assert summary_text(first.summary).splitlines() == ["Ingest summary", "pages: 3", "embedded: 1", "unchanged: 0", "extract skipped: 1", "quality rejected: 1", "errors: 0"]


def _crawl(spark, rows):
    return spark.createDataFrame(rows, "url string, content_hash string, content_type string, body binary, fetched_at timestamp_ntz, fetch_id long")


def test_last_fetch_of_a_url_counts(spark):
    import datetime as dt

    page = lambda w: b"<main><p>" + (w + " ").encode() * 120 + b"</p></main>"
    pages = _crawl(spark, [("u", "h1", "text/html", page("old"), dt.datetime(2025, 1, 1), 1), ("u", "h2", "text/html", page("new"), dt.datetime(2025, 1, 2), 2), ("u", "h2", "text/html", page("new"), dt.datetime(2025, 1, 2), 2)])
    got = ingest(pages)
    assert [(r.url, r.content_hash, r.state) for r in got.documents.collect()] == [("u", "h2", "ok")]
    assert [(r.ordinal, r.content_hash, r.text[:3]) for r in got.chunks.collect()] == [(0, "h2", "new")]


def test_one_failure_stays_alone(spark):
    def encoder(texts):
        if any("bad" in t for t in texts):
            raise ValueError("can't")
        return [[1.0]] * len(texts)

    import datetime as dt

    from corpusmill.config import Settings

    def tokenizer(text):
        if "worse" in text:
            raise RuntimeError("no tokens")
        return chunking.word_spans(text)

    pages = _crawl(spark, [(w, w, "text/html", b"<main><p>" + (w + " ").encode() * 120 + b"</p></main>", dt.datetime(2025, 1, 1), 1) for w in ("good", "bad", "worse")])
    got = ingest(pages, encoder=encoder, tokenizer=tokenizer, settings=Settings(encode_retries=0, encode_backoff_s=0))
    assert {r.url: (r.state, r.error) for r in got.documents.collect()} == {"good": ("ok", None), "bad": ("error", "ValueError: can't"), "worse": ("error", "RuntimeError: no tokens")}
    assert {r.url for r in got.chunks.collect()} == {"good"}


def test_run_ingest_end_to_end(spark, tmp_path):
    import datetime as dt

    from corpusmill.plans.pipeline import run_ingest

    page = lambda w, n=120: b"<title>T</title><main><p>" + (w + " ").encode() * n + b"</p></main>"
    day = lambda d: dt.datetime(2025, 1, d)
    first = [("u", "A1", "text/html", page("one", 500), day(1), 1), ("v", "B1", "text/html", page("two"), day(1), 2), ("w", "C1", "text/html", page("short", 3), day(1), 3), ("x", "D1", "image/png", b"x", day(1), 4)]
    got = run_ingest(spark, str(tmp_path / "s"), _crawl(spark, first))
    assert {r.state: r.n_documents for r in got.summary.collect()} == {"ok": 2, "quality_rejected": 1, "extract_skipped": 1}
    documents = {r.url: r for r in got.documents.collect()}
    assert documents["u"].embedded_hash == "a1" and documents["u"].title == "T" and documents["u"].is_active and not documents["w"].is_active and documents["w"].embedded_hash is None
    ids = {(r.document_id, r.ordinal): r.chunk_id for r in got.chunks.collect()}
    assert len(ids) == 3 and len(set(ids.values())) == 3
    again = run_ingest(spark, str(tmp_path / "s"), _crawl(spark, first))
    assert {r.state: r.n_documents for r in again.summary.collect()} == {"unchanged": 4}
    assert {(r.document_id, r.ordinal): r.chunk_id for r in again.chunks.collect()} == ids and {r.url: r for r in again.documents.collect()} == documents
    then = [*first, ("u", "A2", "text/html", page("three"), day(2), 5), ("v", "B2", "text/html", page("tiny", 2), day(2), 6)]

    def broken(texts):
        raise ValueError("no")

    from corpusmill.config import Settings

    failed = run_ingest(spark, str(tmp_path / "s"), _crawl(spark, then), encoder=broken, settings=Settings(encode_retries=0, encode_backoff_s=0))
    assert {r.state: r.n_documents for r in failed.summary.collect()} == {"unchanged": 2, "error": 1, "quality_rejected": 1}
    assert {r.url: r.embedded_hash for r in failed.documents.collect()}["u"] == "a1" and failed.chunks.count() == 2  # u keeps what it had, v is gone
    last = run_ingest(spark, str(tmp_path / "s"), _crawl(spark, then))
    assert {r.state: r.n_documents for r in last.summary.collect()} == {"unchanged": 3, "ok": 1}
    left = [(r.ordinal, r.text[:5], r.chunk_id) for r in last.chunks.collect()]
    assert left == [(0, "three", ids[documents["u"].document_id, 0])] and not {r.url: r.is_active for r in last.documents.collect()}["v"]


def test_chunks_by_a_subword_tokenizer():
    def pairs(text):  # two characters a token, spaces too: slices may tokenise to more than their share
        return [(i, min(i + 2, len(text))) for i in range(0, len(text), 2)]

    text = " ".join(f"word{i}" for i in range(900)) + ". " + "x" * 5000
    chunks = chunking.chunk_document(_blocks((text, "A")), tokenizer=pairs)
    assert all(c[5] == len(pairs(c[0])) <= 350 for c in chunks) and all(text[c[2] : c[3]] == c[0] for c in chunks)
    covered = set().union(*(range(c[2], c[3]) for c in chunks))
    assert all(i in covered for i, ch in enumerate(text) if ch != " ")
