import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import boilerplate, residue, site_lines, splitting, subjects
from corpusmill.llm.boosting import Boosted

EXTRA = "host string, title string, record_id long, residue string, _text string, line_no int"


def test_residue_rules():
    cases = {
        "Dear {{ first_name }}, welcome.": "placeholder", "Ask the <<Insert course code>> for details": "placeholder", "The fee is %DEADLINE%.": "placeholder", "Write to @@ADVISOR@@ before #{contact_email}": "placeholder",
        "[FIRST NAME] – <%= phone %>": "placeholder", "Welcome to [Insert summary here].": "placeholder", "XXOFFICE_HOURSXX will confirm": "placeholder", "It holds {% include 'x' %} now": "placeholder",
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit.": "filler", "test asdf asdf test test qwer xxxx blah": "filler", "TODO(term): copy to come from the team.": "filler", "Your heading here – phone": "filler",
        "Blindtext Nummer 3: dieser Absatz.": "filler", "Texte d’exemple à remplacer.": "filler", "Placeholder term Placeholder term Placeholder term": "filler",
        "404 Not Found": "error", "Internal Server Error. Reference 1-2.": "error", "Sorry, we could not find that page.": "error", "Traceback (most recent call last): File \"x.py\"": "error", "Page introuvable (erreur 404).": "error",
        "Die Seite wurde nicht gefunden.": "error", "No se encontró la página solicitada (404).": "error", "• ACCESS  DENIED. You lack permission": "error",
        "Please enable JavaScript to view this page.": "scripts", "This app needs scripts. Your browser has them switched off.": "scripts", "Cette page nécessite JavaScript.": "scripts",
        "Fee: undefined. Due: NaN/NaN/NaN. Office: #N/A.": "values",
    }
    assert {t: residue.residue_kind(t) for t in cases} == cases
    for t in (
        "Staff use merge fields such as {{first_name}}; the guide shows how each field is filled in before sending.", "The set {x : x > 12} and its closure cost $75k.", "Designers set lorem ipsum while a page has no copy, with 29 printed examples.",
        "If the portal shows an internal server error, note the time.", "In this course you learn why a server answers 404 Not Found and how to read its log.", "JavaScript for beginners starts in May; enable developer tools in your browser.", "Report a barrier or an error on this page: form 929",
        "The room is still to be announced.", "", "    return render(f\"{name}\");", "At 100% of 50% we stop.", "http://a.example/x?y=1&z=%20",
    ):
        assert residue.residue_kind(t) is None, t
    assert residue.first_residue(["```", "{{ x }}", "```", "fine"]) is None


def test_residue_of_any_length_and_general_grammar():
    long = " while the request was handled by worker" * 40
    cases = {
        "Internal Server Error" + long: "error", "Please enable JavaScript" + long: "scripts", "HTTP Status 500 – Internal Server Error": "error", "Error establishing a database connection": "error", "418 I'm a Teapot": "error", "421 Misdirected Request": "error",
        "Welcome back, [username]!": "placeholder", "Use of JavaScript is required": "scripts", "You need JavaScript enabled to run this app.": "scripts", "An unexpected error has occurred.": "error", "The requested URL /x was not found on this server.": "error",
    }
    assert {t: residue.residue_kind(t) for t in cases} == cases
    for t in ("Liquid uses {{ page.title }} for the heading.", "The tag `{{ x }}` prints x.", "405 students took part.", "500 internal scholarships are given.", "The requested document must not be folded."):
        assert residue.residue_kind(t) is None, t
    assert residue.first_residue(["A template is filled in later.", "{{ x }} holds the name", "```", "{{ y }}", "```"]) is None  # explained and beside code
    assert residue.first_residue(["A template is filled in later.", "Dear {{ x }}, your {{ y }} is {{ z }}"]) == "placeholder"  # dense
    assert residue.first_residue(["Fine", "```", "404 Not Found"]) == "error"  # a fence that is never closed


def _samples(tree):
    """Texts that a parsed rule matches: each alternative of each part once, the other parts at their first."""
    from re import _constants as c

    every = []
    for op, v in tree:
        if op is c.LITERAL:
            every.append([chr(v)])
        elif op is c.IN:
            first = next((x for k, x in v if k is c.LITERAL), None)
            every.append(["1" if (c.CATEGORY, c.CATEGORY_DIGIT) in v else "q" if (c.NEGATE, None) in v or first is None else chr(first)])
        elif op is c.ANY:
            every.append(["q"])
        elif op is c.SUBPATTERN:
            every.append(_samples(v[-1]))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            inner = _samples(v[2])
            every.append(([""] if not v[0] else []) + [x * max(v[0], 1) for x in inner])
        elif op is c.BRANCH:
            every.append([x for b in v[1] for x in _samples(b)])
    out = ["".join(x[0] for x in every)]
    return out + ["".join(w if i == k else x[0] for k, x in enumerate(every)) for i, own in enumerate(every) for w in own[1:]]


def test_every_alternative_of_every_rule_has_a_trigger():
    from re import _parser

    rules = {"placeholder": [residue._PLACEHOLDER], "filler": [residue._FILLER, residue._REPEATED], "values": [residue._VALUES], "error": [residue._ERROR], "scripts": [residue._SCRIPTS]}
    for kind, listed in rules.items():
        for rule in listed:
            samples = _samples(_parser.parse(rule.pattern))
            assert len(samples) > 3 and not [t for t in samples if not any(x in t.lower() for x in residue.TRIGGERS[kind])], kind
    lorem = sorted(w for w in residue.LOREM if len(w) > 3)
    lost = [f"{a} {b} {a} {b}" for a, b in zip(lorem, lorem[1:])] + [" ".join([w] * 4) for w in sorted(residue.MASHED)] + ["zz qq zz qq", "x x x x"]
    lost += ["Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.", "foo bar baz foo bar"]
    assert [t for t in lost if residue.residue_kind(t) != "filler"] == []
    cases = {"405 Method Not Allowed": "error", "Your session has ended.": "error", "Diese Seite existiert nicht.": "error", "Scripts must be enabled.": "scripts", "Scripting is required.": "scripts"}
    assert {t: residue.residue_kind(t) for t in cases} == cases


def test_residue_frames(spark):
    long = "word " * 50_000
    rows = [(1, "a", "t", 0, "r", "x", 0, "Fine.\n{{ x }} is due"), (1, "a", "t", 0, "r", "x", 0, "Fine.\n{{ x }} is due"), (2, None, None, None, None, None, None, None), (3, "", "", 0, "", "", 0, ""), (4, "a", "t", 0, "r", "x", 0, long), (None, "a", "t", 0, "r", "x", 0, "404 Not Found"), (5, "a", "t", 0, "r", "x", 0, long + "\n404 Not Found")]
    df = spark.createDataFrame(rows, f"document_id long, {EXTRA}, full_text string")
    assert {tuple(r) for r in residue.residue_in_texts(df).collect()} == {(1, "placeholder"), (5, "error")}
    assert residue.residue_in_texts(df.limit(0)).count() == 0
    assert {r.document_id for r in residue.without_residue(df).collect()} == {2, 3, 4, None}
    pages = [(1, "text/html", b"<main><p>Fine.</p></main><noscript>Please enable JavaScript.</noscript>"), (2, "text/html; charset=iso-8859-1", "<p>Page introuvable. é</p>".encode("latin-1")), (3, None, None), (4, None, b""), (5, "text/html", b"<pre>{{ x }}</pre><p>ok</p>"), (7, "text/html", b"<html><head><title>404 Not Found</title></head><p>Fine.</p>"), (6, "text/html", b"\xff\xfe<p>{{ x }}</p>"), (6, "text/html", b"\xff\xfe<p>{{ x }}</p>")]
    df = spark.createDataFrame(pages, "fetch_id long, content_type string, body binary")
    assert {tuple(r) for r in residue.residue_in_pages(df).collect()} == {(2, "error"), (6, "placeholder"), (7, "error")}


def test_ingest_leaves_residue_out(spark, tmp_path):

    entry = __import__("__spark_entry__")
    good, bad = b"<main><p>" + b"word " * 120 + b"</p></main>", b"<main><p>404 Not Found</p><p>" + b"word " * 120 + b"</p></main>"
    at = dt.datetime(2025, 1, 1)
    crawls = [(1, "u", "success", "h1", "text/html", at, good), (2, "v", "success", "h2", None, at, bad)]
    spark.createDataFrame(crawls, "fetch_id long, url string, status string, content_hash string, content_type string, fetched_at timestamp_ntz, body binary").write.parquet(str(tmp_path / "crawl_results.parquet"))
    spark.createDataFrame([(7, "u", "Fine."), (8, "v", "404 Not Found")], "document_id long, url string, full_text string").write.parquet(str(tmp_path / "extracted_documents.parquet"))
    spark.createDataFrame([], "run_id int, document_id long, content_hash string, skipped boolean, finished_at timestamp_ntz").write.parquet(str(tmp_path / "embed_results.parquet"))
    assert {tuple(r) for r in entry.queries()["ingest_states"](spark, str(tmp_path)).collect()} == {("ok", 1), ("excluded", 1)}
    assert {tuple(r) for r in entry.queries()["p1_kept"](spark, str(tmp_path)).collect()} == {("crawl", 1), ("extracted", 7)}


def test_splitting_brute_force(spark):
    rng = random.Random(1)
    texts = ["x" * 7000, " " * 5000, "a b " * 2000, "Short.", "", "é" * 2400, "é" * 2401, "\n\n".join("Word word, word. " * rng.randrange(1, 40) for _ in range(30)), " " * 3000 + "y" * 3000]
    for t in texts:
        pieces = splitting.split_text(t)
        assert "".join(t[o:e] for _, o, e in pieces) == t
        assert all(e - s <= 2400 and 0 <= o - s <= 200 for s, o, e in pieces)
        assert all(s < o for s, o, _ in pieces[1:]) or len(t) <= 2400 or not t.strip()
    pieces = splitting.split_text(texts[7])
    assert all(texts[7][o:e].endswith(("\n\n", ". ")) for _, o, e in pieces)
    df = spark.createDataFrame([(1, 0, t, "h", 9) for t in texts[:1]] + [(1, 0, texts[0], "h", 9), (2, None, texts[2], None, None), (3, 0, None, "h", 1), (4, 0, "", "h", 1)], "document_id long, ordinal int, text string, heading_path string, piece_no int")
    got = splitting.split_oversized(df, ["document_id", "ordinal"]).collect()
    assert {(r.document_id, r.ordinal) for r in got} == {(1, 0), (2, None)} and len({(r.document_id, r.piece_no) for r in got}) == len(got)
    assert splitting.split_oversized(df.limit(0), ["document_id", "ordinal"]).count() == 0


def test_splitting_refuses_large_overlap():
    import pytest

    with pytest.raises(ValueError):
        splitting.split_text("x" * 100, 50, 25)


def test_site_lines(spark):
    rows = [(i, "h" if i < 90 else None, f"own line {chr(97 + i % 26)}{chr(97 + i // 26)}\nSHARE  this page {i}!\n\n12345", "x", 1) for i in range(100)] + [(0, "h", "own line aa\nSHARE  this page 0!\n\n12345", "x", 1), (200, "h", None, "x", 1), (201, "h", "", "x", 1), (202, "small", "share this page", "x", 1)]
    df = spark.createDataFrame(rows, "document_id long, host string, full_text string, _key string, line_no int")
    assert {tuple(r) for r in site_lines.repeated_line_occurrences(df).collect()} == {(i, 1) for i in range(100)}
    clean = {r.document_id: r.full_text for r in site_lines.without_repeated_lines(df).collect()}
    assert clean[5] == "own line fa\n\n12345" and clean[200] is None and clean[201] == "" and clean[202] == "share this page"
    assert site_lines.without_repeated_lines(df).count() == len(rows) and site_lines.without_repeated_lines(df).columns == df.columns
    assert site_lines.repeated_line_occurrences(df.limit(0)).count() == 0
    few = spark.createDataFrame([(i, "h", "same") for i in range(3)], "document_id long, host string, full_text string")
    assert site_lines.repeated_line_occurrences(few).count() == 0


def test_boosting_learns():
    rng = np.random.RandomState(0)
    x = rng.rand(4000, 5)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = Boosted().fit(x[:3000], y[:3000], np.ones(3000))
    assert ((model.logits(x[3000:]) > 0) == y[3000:]).mean() > 0.97


CONTENT = [f"In week {i} the class reads about {a} and {b}, and each group reports on its notes from the {a}." for i in range(12) for a in ("rivers", "bridges", "courts", "verbs") for b in ("maps", "models", "cells")]
NAV = ["Home", "News", "Events", "Library", "Sign in", "Contact us", "A to Z", "Maps"]


def _page(i, marked=True):
    rng = random.Random(i)
    nav = "".join(f"<li><a href='/x'>{n}</a></li>" for n in rng.sample(NAV, 5))
    text = "".join(f"<p>{rng.choice(CONTENT)}</p>" for _ in range(6))
    foot = "<p>© 2024 All rights reserved.</p><p>Terms of use · Privacy</p>"
    if marked:
        return f"<html><head><title>t</title></head><body><nav><ul>{nav}</ul></nav><main><h1>Title</h1>{text}</main><footer>{foot}</footer></body></html>".encode()
    return f"<body><div class='c1'><ul>{nav}</ul></div><div class='c2'><h1>Title</h1>{text}</div><div class='c3'>{foot}</div></body>".encode()


ADDED = ["Filed on 3 May 2024 by the desk", "Pass this on to a friend", "Rate this entry: 1 2 3"]


def _corpus(spark, n):
    """Pages, and documents extracted from them with lines added that no page holds."""
    pages, docs = [], []
    for i in range(n):
        url, body = f"https://h{i % 5}.example/{i}", _page(i)
        rng = random.Random(i)
        text = boilerplate.Page(body.decode()).texts
        content = [t for t in text if t.startswith("In week")]
        lines = [*text[:3], "", content[0], "", content[1], "", rng.choice(ADDED), "", content[2], "", "© 2024 All rights reserved."]
        pages.append((i, url, f"A{i}", dt.datetime(2024, 1, 1), "text/html", body))
        docs.append((i, url, f"a{i}", "\n".join(lines)))
    return (spark.createDataFrame(pages + pages[:2], "fetch_id long, url string, content_hash string, fetched_at timestamp, content_type string, body binary"),
            spark.createDataFrame(docs, "document_id long, url string, content_hash string, full_text string"))


def test_boilerplate(spark, tmp_path):
    pages, docs = _corpus(spark, 60)
    sample = boilerplate.sample_documents(docs, pages, documents=40)
    assert len(sample) == 40 and sample == boilerplate.sample_documents(docs.repartition(7), pages.repartition(5), documents=40) and all(r[3] for _, r in sample)
    model = boilerplate.trained([r for _, r in sample])
    model.save(spark, str(tmp_path / "model"))
    model = boilerplate.Furniture.load(spark, str(tmp_path / "model"))
    for i in range(100, 120):  # held out, without telling elements
        body = model.body(_page(i, marked=False).decode())
        assert body.startswith("Title") and body.count("In week") == 6 and not any(f"\n{n}" in body for n in NAV) and "©" not in body
    text = "Home\nNews\nEvents\n\n" + CONTENT[0] + "\n\n" + CONTENT[5] + "\nFiled on 7 June 2023 by the desk\n\nPass this on to a friend\n\n" + CONTENT[9] + "\n\n© 2024 All rights reserved."
    assert model.lines(text) == [0, 1, 2, 7, 9, 13]
    for given in (None, pages):
        rows = [(1, "u", "x", text), (1, "u", "x", text), (2, "u", "x", None), (3, None, None, ""), (4, None, None, " \n "), (5, "u", "x", CONTENT[1] * 3000), (None, "u", "x", text)]
        df = spark.createDataFrame(rows, "document_id long, url string, content_hash string, full_text string").withColumn("line_no", F.lit("x")).withColumn("body", F.lit(1))
        assert {tuple(r) for r in boilerplate.furniture_lines(df, model, given).collect()} == {(1, n) for n in (0, 1, 2, 7, 9, 13)}
        assert {r.document_id for r in boilerplate.main_text(df, model, given).collect()} == {1, 3, 4, 5}
        assert boilerplate.furniture_lines(df.limit(0), model, given).count() == 0
    quality = {q[0]: q for q in boilerplate.held_out(sample)}
    assert set(quality) == {"lines", "lines unmarked", "nodes", "nodes unmarked"} and all(p > 0.95 and r > 0.95 for _, _, p, r in quality.values())
    assert boilerplate.sample_documents(docs.limit(0), pages.limit(0)) == []
    alone = boilerplate.sample_documents(docs.limit(0), pages, documents=30)  # pages only
    assert len(alone) == 30 and boilerplate.trained([r for _, r in alone]).body(_page(101).decode()).startswith("Title")
    assert boilerplate.trained([]).lines("Posted by the editor on 2 May 2024") == [] and boilerplate.trained([]).body("<p>a") == "a"


def test_lines_take_over_their_nodes():
    page = boilerplate.Page("<nav><a href=/>Home</a></nav><MAIN><p>Home runs matter.</p><SCRIPT>var x = 1;</SCRIPT></MAIN><footer>Maps</footer>")
    assert page.texts == ["Home", "Home runs matter.", "Maps"] and page.labels() == [1, 0, 1] and page.links == [1.0, 0.0, 0.0]
    text = boilerplate.Text("home\nHome runs matter.\n\nShare it\nThe gate of the old house is open in spring and autumn.\nInternal Server Error.")
    assert boilerplate.line_labels(text, page, True) == [1, 0, 1, -1, 0] and boilerplate.line_labels(text, page, False) == [1, 0, -1, -1, 0]


def test_deep_pages():
    page = "<div>" * 5_000 + "deep" + "</div>" * 5_000 + "<DIV><p>next</p>"
    assert boilerplate.Page(page).texts == ["deep", "next"] and boilerplate.Furniture([]).body(page) == "deep\n\nnext"


def test_decoding_is_consistent():
    rng = random.Random(5)
    parents, at = [-1, 0, 1, 0, 0], [1, 1, 2, 2, 3, 3, 0]
    for _ in range(200):
        logit = [rng.uniform(-4, 4) for _ in at]
        labels, best = boilerplate.decode(parents, at, logit, price=1.5), -99.0
        kids = {v: [k for k, p in enumerate(parents) if p == v] for v in range(5)}

        def worth(v, forced):
            own = [s for s, a in zip(logit, at) if a == v]
            if forced is not None:
                return (1 if forced else -1) * sum(own) + sum(worth(k, forced) for k in kids[v])
            mixed = sum(map(abs, own)) + sum(worth(k, None) for k in kids[v]) - (1.5 if v and len(own) + len(kids[v]) > 1 else 0)
            return max(mixed, worth(v, True), worth(v, False))

        best = worth(0, None)
        gained = sum(s if y else -s for s, y in zip(logit, labels))
        assert best - 1e-9 <= gained <= best + 3 * 1.5 + 1e-9  # the prices paid are all that lies between
    assert boilerplate.decode([-1], [], []) == []


def test_subjects(spark):
    law = "The court heard witness testimony. A new case on tort claims followed. Bail hearings took place."
    rows = [(1, law), (1, law), (2, None), (3, ""), (4, "  "), (5, "Nothing here."), (6, "Les stages coopératifs et les bourses. Les-bourses sont là."), (7, law + " One passing word on hash tables."), (9, "UNIT  TESTS and “refactoring”. Pull requests!"), (10, law * 500)]
    rows += [(i, "Nothing to see.") for i in range(100, 180)]  # rarity is a share of all documents
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, subject string, score double")
    got = {tuple(r) for r in subjects.document_subjects(df).select("doc_id", "subject").collect()}
    assert got == {(1, "law"), (6, "student_services"), (7, "law"), (9, "software"), (10, "law")}
    assert subjects.document_subjects(df.limit(0)).count() == 0
    assert {r.subject: r.n_documents for r in subjects.composition(df).collect()}["law"] == 3
    assert subjects.calibrate([({"law": 3.0, "arts": 0.5}, 5, {"law"})])[2] == 1.0


def test_subjects_learn_from_labels(spark):
    word = lambda i, k: f"The {('quorn', 'blick', 'zamt')[k]} {('sorvel', 'tindal')[i % 2]} stood open. Then the {('quorn', 'blick', 'zamt')[k]} closed again."
    rows = [(i, word(i, i % 3)) for i in range(90)]
    labels = [(i, ("arts", "law", "sport")[i % 3], "x") for i in range(60)] + [(0, "arts", "y"), (None, "law", "x"), (7, None, "x"), (999, "law", "x")]
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string, labeller string")
    got = {tuple(r) for r in subjects.document_subjects(df, known).select("doc_id", "subject").collect()}
    assert {(i, ("arts", "law", "sport")[i % 3]) for i in range(60, 90)} == {x for x in got if x[0] >= 60}
    assert {r.recall for r in subjects.agreement(spark, df, known).collect()} == {1.0}
    assert subjects.document_subjects(df, known.limit(0)).count() == 0


def test_longer_terms_win():
    table = subjects.Terms("law | en | 1 | court\nsport | en | 1 | tennis court; sprint*\n# x", [("yield", "science", 0.9)])
    name = lambda t: {table.subject[i] for f in table.in_text(t)[1] for i in f}
    assert name("The tennis courts open.") == {"sport"} and name("Courts of tennis. Sprinting!") == {"law", "sport"} and name("Yields") == {"science"} and name("") == set()
