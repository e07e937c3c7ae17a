from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, classify, code, incremental, quality, relations, search, usage
from corpusloom.sources import formats


def md(spark, *texts):
    return spark.createDataFrame([(f"f{i}.md", t) for i, t in enumerate(texts)], "file string, text string")


def test_sections_and_breadcrumbs(spark):
    s = chunking.sections(md(spark, "x\n# A\na\n## B\nb\n### C\n## D\n# E\n```\n## F\n```"), "file", "text").orderBy("ord").collect()
    assert [(r.heading, r.heading_path, r.line_start, r.line_end) for r in s] == [
        ("intro", "", 1, 1), ("A", "A", 2, 3), ("B", "A > B", 4, 5), ("C", "A > B > C", 6, 6), ("D", "A > D", 7, 7), ("E", "E", 8, 9), ("F", "E > F", 10, 11)]
    s = chunking.sections(md(spark, "# A\n```\n## F\n```\n## G"), "file", "text", skip_fences=True).orderBy("ord").collect()
    assert [r.heading for r in s] == ["A", "G"]


def test_short_chunks_go_and_ids_follow_contents(spark):
    d = md(spark, "# Title\nword", "# Title\n" + "word " * 20, "", None)
    got = chunking.heading_chunks(d, "file", "text").collect()
    assert len(got) == 1
    assert got[0].text.startswith("[Title]\n\n# Title")
    assert chunking.heading_chunks(d.orderBy(F.desc("file")), "file", "text").first().chunk_id == got[0].chunk_id


def test_cuts_cover_the_text_and_prefer_full_stops():
    text = "One two three. " * 40
    cuts = chunking.cuts(text, 100, 10)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(b2 - 10 == a for (_, b2), (a, _) in zip(cuts[:-1], cuts[1:], strict=False))
    assert chunking.cuts("x" * 195, 200, 50) == [(0, 195), (150, 195)]  # a tail within the piece before
    assert chunking.cuts("x" * 150, 200, 50) == [(0, 150)]
    assert text[: cuts[0][1]].endswith(".")
    with pytest.raises(ValueError, match="half"):
        chunking.fixed_chunks(None, "a", "b", 100, 60)


def test_hybrid_chunks_cut_long_sections(spark):
    got = chunking.hybrid_chunks(md(spark, "# A\n" + "short text. " * 10 + "\n# B\n" + "long text here. " * 300), "file", "text").orderBy("ord", "part").collect()
    assert [(r.heading, r.part) for r in got] == [("A", 0), ("B (part 1)", 1), ("B (part 2)", 2), ("B (part 3)", 3)]
    assert [(r.line_start, r.line_end) for r in got] == [(1, 2), (3, 4), (4, 4), (4, 4)]


def test_chunks_are_numbered_among_those_that_stay(spark):
    text = "intro\n# A\n" + "word " * 20 + "\n# B\nx\n# C\n" + "more " * 20
    got = chunking.heading_chunks(md(spark, text), "file", "text").orderBy("ord").collect()
    assert [(r.ord, r.heading) for r in got] == [(0, "A"), (1, "C")]
    f = chunking.fixed_chunks(md(spark, " \n" * 60 + "y" * 60, "z" * 300), "file", "text", 100, 10).orderBy("source", "ord").collect()
    assert [(r.source, r.ord, r.heading, r.line_start, r.line_end, r.char_count) for r in f][:2] == [("f0.md", 0, "chunk-0", 46, 61, 60), ("f1.md", 0, "chunk-0", 1, 1, 100)]
    assert [r.ord for r in f if r.source == "f1.md"] == [0, 1, 2]


def test_bm25_by_hand(spark, tmp_path):
    import math

    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, "")], "id long, text string")
    q = spark.createDataFrame([(0, "apple apple banana")], "qid long, text string")
    index = search.build(docs, str(tmp_path / "index"))
    assert {(r.id, r.term, r.tf, r.dl) for r in index.postings.collect()} == {(1, "apple", 2, 3), (1, "banana", 1, 3), (2, "banana", 1, 2), (2, "cherry", 1, 2)}
    got = {r.id: r.score for r in search.bm25(index, q).collect()}
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    w = lambda df, tf, dl: idf(df) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / (5 / 3)))
    assert got == {1: pytest.approx(2 * w(1, 2, 3) + w(2, 1, 3), abs=1e-6), 2: pytest.approx(w(2, 1, 2), abs=1e-6)}


#: A small corpus of our own: a question for each file, and the type it has.
CORPUS = [
    ("bugfix-log/login-loop.md", "bugfix", "Users were sent back to the login form because the session cookie expired at once. The clock of the container was behind.", "why do users return to the login form"),
    ("bugfix-log/slow-invoices.md", "bugfix", "Invoices took minutes to print since every line asked the currency table again. A join in one statement mended it.", "invoices print slowly"),
    ("architecture/queue.md", "architecture", "Orders pass through a message queue so that payment and shipping can fail without each other. Messages are kept for a week.", "how do orders reach shipping when payment fails"),
    ("architecture/storage.md", "architecture", "Pictures live in an object store and their thumbnails in a cache. The database keeps paths only.", "where do pictures and thumbnails live"),
    ("api/customers.md", "api", "The customers endpoint lists accounts by page. Each request needs a token in its header and answers with a cursor.", "page through customer accounts"),
    ("api/webhooks.md", "api", "Partners register a webhook address. Each delivery is signed and retried with growing pauses.", "are webhook deliveries retried"),
    ("setup/laptop.md", "setup", "Install the compiler and the container engine, then copy the sample environment file and start all services.", "install a new laptop"),
    ("setup/backup.md", "setup", "A nightly job dumps the database to another region. Restoring takes an hour and is rehearsed each quarter.", "restore the nightly dump"),
    ("tests/checkout.md", "test", "A buyer with an empty basket must not reach checkout. Steps: open the shop, remove all goods, press the button.", "empty basket at checkout"),
    ("best-practices/reviews.md", "best-practice", "Small changes are reviewed within a day. Reviewers ask before they demand and name the line they mean.", "how soon are changes reviewed"),
]


def test_search_finds_the_right_files(spark, tmp_path):
    docs = spark.createDataFrame([(s, s, t, x, 1, 1) for s, t, x, _ in CORPUS], "id string, source string, type string, text string, line_start int, line_end int")
    index = search.build(docs, str(tmp_path / "index"))
    q = spark.createDataFrame([(i, x[3]) for i, x in enumerate(CORPUS)], "qid long, text string")
    gold = spark.createDataFrame([(i, x[0]) for i, x in enumerate(CORPUS)], "qid long, id string")
    for ranked in (search.hybrid(index, q), search.top(search.bm25(index, q), 5)):
        e = search.evaluate(ranked, gold).first()
        assert e.p_at_1 >= 0.5 and e.p_at_k >= 0.7 and e.mrr >= 0.5
    typed = search.hybrid(index, q, 3, "api").collect()
    assert typed and {r.type for r in typed} == {"api"} and typed[0].location.endswith(":1-1")
    assert {r.relevance >= 50 for r in search.hybrid(index, q, least=50).collect()} <= {True}
    again = search.Index.read(spark, str(tmp_path / "index"))
    assert search.bm25(again, q).count() == search.bm25(index, q).count()
    files = spark.createDataFrame([(0, "api/customers.md")], "qid long, path string")
    assert search.file_context(again, files, 4, 10).where("rank = 1").first().text == "The custom"


def test_gold_pairs_share_a_run_of_words(spark):
    words = " ".join(f"word{i}" for i in range(12))
    d = spark.createDataFrame([(1, "before " + words[:70] + " after"), (2, "word1 word2 word3"), (3, words)], "id long, text string")
    assert {(r.qid, r.id) for r in search.shared_runs(d, spark.createDataFrame([(9, words)], "qid long, text string")).collect()} == {(9, 1), (9, 3)}


def test_relevance_is_a_share_of_the_best(spark):
    h = spark.createDataFrame([(0, "a", 10.0), (0, "b", 5.0), (0, "c", 0.0)], "qid long, id string, score double")
    assert {r.id: r.relevance for r in search.relevance(h).collect()} == {"a": 100.0, "b": 50.0, "c": 0.0}


def test_fusion_weights_the_lists(spark):
    v = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "qid long, id string, rank int")
    k = spark.createDataFrame([(0, "b", 1), (0, "c", 2)], "qid long, id string, rank int")
    assert [r.id for r in search.fused_top(search.fuse(v, k, 0.5, 1.5), 3).orderBy("rank").collect()] == ["b", "c", "a"]
    only = search.fuse(v, k, 1.0, 0.0)
    assert [r.id for r in search.fused_top(only, 2).orderBy("rank").collect()] == ["a", "b"]


def test_evaluation(spark):
    r = spark.createDataFrame([(0, "a", 1), (1, "x", 1), (1, "b", 2)], "qid long, id string, rank int")
    g = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "qid long, id string")
    e = search.evaluate(r, g).first()
    assert (e.n_queries, e.p_at_1, e.p_at_k, e.mrr) == (3, pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6), pytest.approx(0.5))


def test_heading_jumps(spark):
    got = {r.file: r.level for r in quality.heading_jumps(md(spark, "# a\n### b\n", "### a\n## b\n", "# a\n## b\n### c\n", "# a\n```\n#### x\n```\n", "# a\n## b\n# c\n### d\n", "### a\n# b\n### c\n", "---\nx: 1\n---\n# a\n##### b\n### c\n")).collect()}
    assert got == {"f0.md": 3, "f6.md": 5}


BUGFIX = "# Fix\n## Root Cause\nA description that is long enough to say what it has to say.\n## 🔧 Solution\nA description that is long enough to say what it has to say.\n## **Lesson Learned**\nA description that is long enough to say what it has to say.\n"


def test_required_sections(spark):
    d = spark.createDataFrame([("bugfix-log/a.md", BUGFIX), ("bugfix-log/b.md", BUGFIX.replace("Root Cause", "Cause")), ("bugfix-log/README.md", "x"), ("tests/c.md", "# T\n## Scenario\nx\n")], "file string, text string")
    got = {(r.file, r.severity, r.rule, r.message) for r in quality.content_issues(d).collect()}
    assert ("bugfix-log/b.md", "critical", "R9", "missing section Root Cause") in got
    assert {m for f, s, r, m in got if r == "R10"} == {"missing section Steps", "missing section Expected Result"}
    assert ("tests/c.md", "warning", "R11", "thin section Scenario") in got
    assert not [g for g in got if g[0] in ("bugfix-log/a.md", "bugfix-log/README.md")]
    whole = {(r.file, r.rule) for r in quality.content_issues(d, whole=True).collect()}
    assert ("bugfix-log/b.md", "R9") in whole and not [r for _, r in whole if r == "R10"]
    kept, why = quality.gate(d, quality.content_issues(d))
    assert {r.file for r in kept.collect()} == {"bugfix-log/a.md", "bugfix-log/README.md"}
    assert {r.file for r in why.collect()} == {"bugfix-log/b.md", "tests/c.md"}


def test_rules_on_single_files(spark):
    head = "---\nid: x\nowner: me\nstatus: draft\n---\n"
    long = "A sentence that says enough to be of use to whoever reads it, and then says so again, to be sure of it."
    files = {"a.md": head + "# T\n", "b.md": f"# T\n{long}\n", "c.md": f"## T\n{long}\n", "d.md": long, "e.md": "# T\nForty characters of text stand on this line.\n", "f.md": "```\n# in a fence\n```\n" + long, "g.txt": "", "x/README.md": "", "x/y/README.md": ""}
    d = spark.createDataFrame(list(files.items()), "file string, text string")
    got = {}
    for r in quality.content_issues(d).collect():
        got.setdefault(r.file, set()).add((r.severity, r.rule, r.message))
    assert got == {
        "a.md": {("warning", "R4", "very short: 0"), ("info", "R12", "unknown key owner"), ("warning", "R13", "status draft")}, "c.md": {("info", "R7", "first heading has level 2")}, "d.md": {("info", "R6", "no headings")},
        "e.md": {("info", "R5", "short: 44")}, "f.md": {("info", "R6", "no headings")}, "x/y/README.md": {("warning", "R4", "very short: 0"), ("info", "R6", "no headings")},
    }
    report = [r.line for r in quality.report(quality.content_issues(d), "p", 2).orderBy("pos").collect()]
    assert report[:2] == ["**Quality 94/100** (p)", "Critical: 0, warnings: 3, notes: 6"] and len(report) == 4 and report[2].startswith("- [warning] **a.md**")


def test_contents_are_checked_before_they_are_files(spark):
    d = spark.createDataFrame([("k1", "bugfix", BUGFIX), ("k2", "bugfix", "# T\n"), ("k3", "docs", "# T\n"), ("k4", "test", "# T\n")], "key string, category string, text string")
    got = Counter((r.key, r.rule) for r in quality.check_content(d).collect())
    assert got == {("k2", "R9"): 3, ("k2", "R4"): 1, ("k3", "R4"): 1, ("k4", "R4"): 1, ("k4", "R10"): 3}


def test_score_caps_each_severity(spark):
    i = spark.createDataFrame([("critical",)] * 9 + [("warning",)] * 2 + [("info",)] * 50, "severity string")
    assert quality.score(i).first().asDict() == {"n_critical": 9, "n_warning": 2, "n_info": 50, "score": 36}
    assert quality.score(i.where("false")).first().score == 100


def test_centroids_and_plan(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 1, [0.0, 1.0]), (4, 1, [-1.0, -1.0])], "id long, label int, vec array<float>")
    got = {r.id: r.nearest for r in classify.nearest_centroid(v, classify.centroids(v)).collect()}
    assert got[1] == got[2] == 0
    s = spark.createDataFrame([("notes/api.md", "api"), ("api/x.md", "api"), ("README.md", "api"), ("y.md", "setup"), ("z.md", "docs")], "rel_path string, category string")
    assert {r.destination for r in classify.misplaced(s).collect()} == {"api/api.md", "setup/y.md"}


def events(spark, rows):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(p, t0 + timedelta(seconds=s), i, k, tool, hit, 4, 1, 2, 30.0, 20.0) for i, (p, s, k, tool, hit) in enumerate(rows)], "project long, ts timestamp_ntz, event_id long, kind string, tool string, hit boolean, found int, fixed int, blocking int, baseline double, actual double")


def test_impact(spark):
    assert usage.impact(events(spark, [(1, 0, "search_result", "t", False), (1, 3600 * 24 * 31, "x", None, None)])).first().searches == 0
    r = usage.impact(events(spark, [(1, 0, "search_result", "search_docs", True), (1, 5, "guardrail_report", None, None)])).first()
    assert (r.minutes_observed, r.minutes_saved, r.hours_saved, r.found, r.fixed) == (10.0, 27.5, 0.46, 4, 1)


def test_counters_and_nudges(spark):
    e = events(spark, [(1, i, "search_result", "search_bugfixes", False) for i in range(3)] + [(2, 9, "tool_call", "write_bugfix_summary", None)])
    c = usage.counters(e)
    assert {r.project: (r.bugfix_searches, r.misses, r.last_tool) for r in c.collect()} == {1: (3, 3, "search_bugfixes"), 2: (0, 0, "write_bugfix_summary")}
    assert sorted(r.nudge for r in usage.nudges(c).collect()) == ["fill the gaps", "write down bug fixes"]


def test_streaks_states_and_rate_limits(spark):
    e = events(spark, [(1, i, "f" if i != 1 else "ok", None, None) for i in range(5)] + [(2, 0, "f", None, None), (3, 0, "ok", None, None)])
    got = {r.project: (r.streak, r.healthy) for r in usage.failure_streaks(e, "project", F.col("kind") == "f").collect()}
    assert got == {1: (3, False), 2: (1, True), 3: (0, True)}
    s = usage.last_known(e, "project", F.when(F.col("ts") > "2024-01-01 00:00:02", "unknown").otherwise(F.concat(F.lit("s"), F.col("event_id").cast("string"))))
    assert {r.project: r.state for r in s.collect()} == {1: "s2", 2: "s5", 3: "s6"}
    r = usage.rate_limited(events(spark, [(1, s, "x", None, None) for s in (0, 1, 62, 121, 122)]), "project").first()
    assert (r.n_events, r.n_emitted) == (5, 3)


def test_divergence(spark):
    d = spark.createDataFrame([(0, 0), (1, 0), (0, 2), (1, 1), (None, 0)], "a int, b int").select(usage.divergence(F.col("a"), F.col("b")))
    assert [r[0] for r in d.collect()] == ["synced", "ahead", "behind", "diverged", "no-upstream"]


def test_hydration_lets_the_hot_tier_win(spark):
    hot, mirror = spark.createDataFrame([(1, 100)], "p long, n long"), spark.createDataFrame([(1, 999), (2, 42)], "p long, n long")
    assert {tuple(r) for r in usage.hydrate(hot, mirror, "p").collect()} == {(1, 100), (2, 42)}


def test_an_index_is_brought_in_step(spark):
    body = lambda w: f"# {w}\n" + f"{w} " * 30
    files = lambda **x: spark.createDataFrame([(f"notes/{k}.md", v) for k, v in x.items()], "path string, text string")
    none = spark.createDataFrame([], "path string, content_md5 string")
    first = files(a=body("Alpha"), b=body("Beta"), c=body("Gamma"))
    empty = chunking.heading_chunks(first.select(F.col("path").alias("file"), "text"), "file", "text").where("false")
    chunks, state, stats = incremental.index_run(first, none, empty)
    assert {r.heading for r in chunks.collect()} == {"Alpha", "Beta", "Gamma"} and stats.first().files_new == 3
    second = files(a=body("Alpha"), b=body("Better"), d=body("Delta")).union(spark.createDataFrame([("tests/t.md", "# no sections " + "x" * 90)], "path string, text string"))
    after, now, stats = incremental.index_run(second, state, chunks)
    assert {(r.source, r.heading) for r in after.collect()} == {("notes/a.md", "Alpha"), ("notes/b.md", "Better"), ("notes/d.md", "Delta")}
    assert {r.path for r in now.collect()} == {"notes/a.md", "notes/b.md", "notes/d.md"}
    assert stats.first().asDict() == {"files_seen": 4, "files_new": 1, "files_modified": 1, "files_unchanged": 1, "files_rejected": 1, "files_removed": 1}
    again, _, stats = incremental.index_run(second, now, after)
    assert again.count() == 3 and stats.first().files_unchanged == 3
    kept, held, _ = incremental.index_run(second.where("false"), now, after)  # a failed scan empties nothing
    assert kept.count() == 3 and held.count() == 3


def test_relations(spark):
    d = spark.createDataFrame([("a.md", "---\nid: adr-42\nreplaces: [adr-17]\n---\n"), ("b.md", "---\nid: adr-17\nstatus: superseded\n---\n"), ("c.md", "---\nid: adr-99\ndepends_on: ghost\n---\n"), ("d.txt", "---\nid: no\n---\n"), ("e.md", "none")], "path string, text string")
    e = relations.entities(d)
    assert {tuple(r) for r in relations.edges(e).collect()} == {("adr-42", "replaces", "adr-17", True), ("adr-99", "depends_on", "ghost", False)}
    assert [tuple(r) for r in relations.inbound(e).collect()] == [("adr-17", 1, "replaces:adr-42")]


def test_incremental(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_md5 string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("z", "9")], "path string, content_md5 string")
    assert {(r.path, r.change) for r in incremental.changed(now, old).collect()} == {("b", "modified"), ("c", "new")}
    assert incremental.changed(now, now).count() == 0
    assert [r.path for r in incremental.stale(old.select("path"), now.select("path"), "path").collect()] == ["z"]
    assert incremental.stale(old.select("path"), now.where("false").select("path"), "path").count() == 0
    new = spark.createDataFrame([("a", "5"), ("a", "7")], "path string, content_md5 string")
    assert {tuple(r) for r in incremental.upsert(now, new, "path", "content_md5").collect()} == {("a", "7"), ("b", "2"), ("c", "3")}


def test_code_units(spark):
    py = '"""Doc."""\nimport os, sys\nfrom a import b\n\nclass K:\n    """A class."""\n    def m(self): pass\n\nasync def _h(): pass\ndef f():\n    import x\n'
    u = code.python_units(spark.createDataFrame([("a.py", py), ("b.py", "def ("), ("c.py", None), ("d.py", '"""Only a module."""\nx = 1'), ("e.py", "def f(): pass")], "path string, text string")).orderBy("path").collect()
    assert (u[0].symbols, u[0].docstring, u[0].import_count, u[0].public_functions, u[0].has_docstrings) == (["class K", "_h", "f", "m"], "A class.", 3, 2, True)
    assert [(x.symbols, x.docstring, x.import_count, x.has_docstrings) for x in u[1:]] == [([], "", 0, False), ([], "", 0, False), ([], "Only a module.", 0, True), (["f"], "", 0, False)]
    ts = "/** Says\n * it. */\nimport x from 'x'\nrequire('y')\nconst a = 1\nexport async function f() {}\nexport class K {}\nlet _own = 2\n"
    r = code.script_units(spark.createDataFrame([("a.ts", ts)], "path string, text string")).first()
    assert (r.symbols, r.import_count, r.public_functions, r.docstring, r.has_docstrings) == (["a", "f", "K", "_own"], 2, 3, "Says it.", True)


def test_a_code_base_end_to_end(spark):
    files = {
        "src/main.py": '"""The entry point."""\nimport os\nimport sys\nfrom pathlib import Path\n\ndef run():\n    """Run it."""\n\nclass App:\n    def start(self): pass\n',
        "src/utils.py": "def help_me(x):\n    return x\n", "src/api.ts": "/** The client. */\nimport a from 'a'\nimport b from 'b'\nexport function get() {}\n", "README.md": "# Read\n", "config/package.json": "{}",
        "node_modules/x/index.js": "x", "src/__pycache__/u.py": "x", "src/logo.PNG": "x", ".hidden/a.py": "x", "out/b.py": "x",
    }
    d = spark.createDataFrame([(p, t, len(t)) for p, t in files.items()], "path string, text string, size long")
    u = code.units(code.source_files(d)).cache()
    assert {r.path: (r.language, r.category, r.score, r.line_count) for r in u.collect()} == {
        "src/main.py": ("python", "api", 6.8, 10), "src/utils.py": ("python", "best-practices", 0.6, 2), "src/api.ts": ("typescript", "api", 6.0, 4), "README.md": ("other", "docs", 0.0, 1), "config/package.json": ("other", "docs", 0.0, 0)
    }
    assert [r.path for r in code.to_document(u, 3).collect()] == ["src/main.py", "src/api.ts", "src/utils.py"]
    assert [r.folder for r in code.undocumented(u).collect()] == ["config"]
    assert tuple(code.totals(u).first()) == (5, 17, 3)
    assert [(r.language, r.n) for r in code.ranked(code.distributions(u)).where("level = 1").collect()] == [("other", 2), ("python", 2), ("typescript", 1)]


def test_source_files_skip_folders(spark):
    d = spark.createDataFrame([("src/a.py", 10), ("node_modules/b.js", 10), (".git/c", 10), ("gen/d.py", 10), ("src/e.py", 600_000), ("src/f.lock", 1), ("out/g.py", 1)], "path string, size long")
    ignored = spark.createDataFrame([("gen/",), ("# src",), ("",)], "part string")
    assert [r.path for r in code.source_files(d, ignored).collect()] == ["src/a.py"]


def test_near_duplicates_cluster_around_seeds_in_order(spark):
    import math

    at = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), 0.0]
    # b is near a and c; c is near b only, and so seeds a cluster of its own with d
    v = spark.createDataFrame([("a", at(0)), ("b", at(20)), ("c", at(40)), ("d", at(60)), ("a2", at(0)), ("z", [0.0, 0.0, 1.0]), ("n", [0.0, 0.0, 0.0])], "id string, vec array<double>")
    got = {r.seed: (r.files, r.n, r.similarity) for r in classify.duplicate_clusters(v).collect()}
    near = round(math.cos(math.radians(20)), 3)
    assert got == {"a": (["a", "a2", "b"], 3, round((1 + near) / 2, 3)), "c": (["c", "d"], 2, near)}
    assert classify.duplicate_clusters(v.where("id IN ('a', 'z')")).count() == 0


def test_clusters_equal_the_greedy_rule(spark):
    import numpy as np

    r = np.random.default_rng(5)
    base = r.standard_normal((12, 8))
    x = np.concatenate([base[i % 12] + 0.22 * r.standard_normal(8) for i in range(90)]).reshape(90, 8).round(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    used, want = set(), {}
    for i in range(90):
        if i not in used:
            near = [j for j in range(i + 1, 90) if j not in used and u[i] @ u[j] >= 0.92]
            if near:
                used |= {i, *near}
                want[i] = [i, *near]
    got = {c.seed: c.files for c in classify.duplicate_clusters(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")).collect()}
    assert got == want


def test_a_plan_is_numbered_and_sums_up(spark):
    f = spark.createDataFrame([("notes/api.md", "api", 0.65), ("api/x.md", "api", 0.95), ("y.md", "setup", 0.65), ("z.md", "docs", 0.3)], "rel_path string, category string, confidence double")
    clusters = spark.createDataFrame([(["y.md", "z.md"], 0.987)], "files array<string>, similarity double")
    actions = classify.plan(f.select("rel_path"), f, clusters, ["api", "setup", "tests"])
    assert [(r.id, r.type, r.path, r.destination) for r in actions.orderBy(F.col("id")).collect()] == [
        ("a1", "create_dir", "setup/", None), ("a2", "create_dir", "tests/", None), ("a3", "move", "notes/api.md", "api/api.md"), ("a4", "move", "y.md", "setup/y.md"), ("a5", "flag_review", None, None)]
    s = classify.plan_summary(f, actions, spark.createDataFrame([(1,)], "n long"), spark.createDataFrame([(80,)], "score long")).first()
    assert (s.total_files, s.categories, s.misplaced, s.clusters, s.folders_to_create, s.actions, s.score_projected) == (4, 3, 2, 1, 2, 5, 86)
    assert {tuple(r) for r in classify.decided(actions, spark.createDataFrame([("a3",), ("a9",)], "id string")).collect()} == {("a3", "move"), ("a9", "unknown")}
    moved = {r.rel_path: r.proposed_destination for r in classify.inventory(f, actions).collect()}
    assert moved == {"notes/api.md": "api/api.md", "api/x.md": None, "y.md": "setup/y.md", "z.md": None}


def test_numbering_does_without_one_task(spark):
    from corpusloom.sources.store import numbered

    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = numbered(d, "n", F.col("x")).collect()
    assert sorted((r.x, r.n) for r in got) == [(i, i + 1) for i in range(1000)]


def test_progress_and_search_counters(spark):
    d = spark.createDataFrame([(1, 8), (3, 8), (0, 0), (1, 1)], "a int, b int").select(usage.progress(F.col("a"), F.col("b")))
    assert [r[0] for r in d.collect()] == [12, 38, 0, 100]
    e = events(spark, [(1, 0, "search_result", "search_docs", True), (1, 9, "search_result", "other", False), (1, 99, "tool_call", "search_docs", None)])
    r = usage.searches(e, ["search_docs", "search_tests"]).first()
    assert (r.searches, r.hits, r.misses, r.by_tool, r.last_search.second) == (2, 1, 1, {"search_docs": 1, "search_tests": 0}, 9)


@pytest.mark.parametrize(
    ("path", "content", "want"),
    [
        ("a.html", "<h1> T </h1><script>x</script><ul><li>one</li><li>two</li></ul><p>say <code>c</code></p><table><tr><td>1</td><td>2</td></tr></table><pre>x\ny</pre>", "# T\n\n- one\n- two\n\nsayc\n\n`c`\n| 1 | 2 |\n\n```\nx\ny\n```"),
        ("a.html", "<nav><p>no</p></nav>text<ul><li><p>in</p></li></ul><pre><code>k</code></pre><p> </p><code>a b</code><header>h</header>", "- in\n\nin\n\n\n```\nk\n```\n\n`a b`"),
        ("a.html", "<p>open <b>bold</p><p>next<br>line</p><h6>deep</h6>", "openbold\n\n\nnextline\n\n\n###### deep"),
        ("a.html", "<body></body>", None),
        ("a.rst", "-----\nTitle\n-----\n\nPart\n~~~~\n\n.. code-block:: python\n\n   x = 1\n\nend", "\n# Title\n\n\n\n### Part\n\n\n\n```\nx = 1\n\n```\n\nend"),
        ("a.rst", "Other\n*****\ntext", "\n## Other\n\ntext"),
        ("a.csv", "a,b\n1\n\n1,2,3\n", "| a | b |\n| --- | --- |\n| 1 |  |\n|  |  |\n| 1 | 2 |"),
        ("a.csv", "", "(empty)"),
        ("a.json", '{"k":"é"}', '```json\n{\n  "k": "é"\n}\n```'),
        ("a.json", "{no", "```json\n{no\n```"),
        ("a.docx", "not a zip", None),
    ],
)
def test_parsers(spark, path, content, want):
    d = spark.createDataFrame([(path, content)], "path string, content string")
    assert formats.parsed(d, "path", "content").first().markdown == want


def test_files_to_markdown(spark, tmp_path):
    for name, body in {"a.txt": "hi", "b.md": "# B", "c.yaml": "k: v", "d.bin": "x", "sub/e.html": "<p>x</p>", "f.json": "{}", "g.csv": "a"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {r.path.rsplit("/", 1)[1]: r.text for r in formats.to_markdown(formats.discover(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": "# a.txt\n\nhi", "b.md": "# B", "c.yaml": "# c.yaml\n\n```yaml\nk: v\n```", "e.html": "# e.html\n\nx", "f.json": "# f.json\n\n```json\n{}\n```", "g.csv": "# g.csv\n\n| a |\n| --- |"}


def test_nested_repositories_are_left_out(spark):
    f = spark.createDataFrame([("docs/a.md",), ("docs/sub/b.md",), ("docs/subway/c.md",)], "path string")
    assert [r.path for r in formats.outside(f, spark.createDataFrame([("docs/sub",)], "root string")).orderBy("path").collect()] == ["docs/a.md", "docs/subway/c.md"]


@pytest.mark.parametrize("side", [512, 40])
def test_many_alike_vectors_are_no_pairs(spark, monkeypatch, side):
    import numpy as np

    monkeypatch.setattr(classify, "SIDE", side)
    r = np.random.default_rng(6)
    x = np.concatenate([[1.0, 0, 0, 0, 0, 0]] * 1500).reshape(1500, 6) + 0.05 * r.standard_normal((1500, 6))
    x = np.concatenate([x[:700], r.standard_normal((60, 6)), x[700:]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    like, seeds, want = u @ u.T, [], []
    for i in range(len(u)):
        first = next((s for s in seeds if like[s, i] >= classify.DUPLICATE), i)
        seeds += [i] * (first == i)
        want.append(first)
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "id long, vec array<double>")
    sizes = []
    real = classify.written
    monkeypatch.setattr(classify, "written", lambda d, what: (lambda out: (sizes.append((what, out.count())), out)[1])(real(d, what)))
    got = {c.id: c.seed for c in classify.clustered(v).collect()}
    assert [got[i] for i in range(len(u))] == want
    tables = max(n for what, n in sizes if what == "codes") / len(u)
    assert all(n <= (tables if what in ("codes", "sizes") else 1) * len(u) for what, n in sizes)
    monkeypatch.setattr(classify, "SHOWN", 5)
    top = max(classify.duplicate_clusters(v).collect(), key=lambda c: c.n)
    assert top.n > 1400 and top.files == [i for i, s in enumerate(want) if s == top.seed][:5]


def test_a_missing_folder_scores_nothing(spark, tmp_path):
    gone = quality.missing_folder(spark, str(tmp_path / "none"))
    assert [tuple(r)[1:] for r in gone.collect()] == [("critical", "R1", "no such folder")]
    assert tuple(quality.score(gone).first()) == (1, 0, 0, 0)
    (tmp_path / "a.md").write_text("x")
    assert quality.score(quality.missing_folder(spark, str(tmp_path))).first().score == 100


def test_critical_rules_alone_are_the_same_rows(spark):
    texts = [("bugfix-log/a.md", "# A\n## Root Cause\nx"), ("tests/b.md", "text"), ("notes/c.md", ""), ("tests/d.md", "---\nstatus: odd\n---\n## Steps\n## Scenario\n## Expected Result\n")]
    f = spark.createDataFrame(texts, "file string, text string")
    every, some = quality.content_issues(f), quality.content_issues(f, rules=quality.CRITICAL)
    assert sorted(map(tuple, some.collect())) == sorted(tuple(r) for r in every.collect() if r.rule in quality.CRITICAL)
    assert {r.rule for r in quality.content_issues(f, rules=("R6",)).collect()} == {"R6"}


def test_too_many_queries_are_refused(spark, monkeypatch):
    from corpusloom.sources import store

    monkeypatch.setattr(store, "BROADCAST_BYTES", 10)
    v = spark.createDataFrame([(1, [1.0, 0.0])], "id int, vec array<double>")
    index = search.Index(v, v, v, v, v)
    with pytest.raises(ValueError, match="too many"):
        search.nearest(index, v.withColumnRenamed("id", "qid"), 1)


def test_packed_vectors_are_what_they_were(spark):
    vecs = [[1.0, -127.0, 0.0], [128.0, -5.0, 3.0], [-32767.0, 32767.0, 0.0], [32768.0, 1.0, 0.0], [0.5, 1 / 3, -2.0], [0.0, 2.0, 1.0]]
    c = spark.createDataFrame(list(enumerate(vecs)), "node long, vec array<double>")
    for some in (c, c.where("node IN (0, 5)")):
        got = classify._packed(some.coalesce(1)).orderBy("node").toArrow()
        assert classify._unpacked(got["vec"]).tolist() == [vecs[n] for n in got["node"].to_pylist()]
    assert [len(r.vec) for r in classify._packed(c).orderBy("node").collect()] == [4, 7, 7, 25, 25, 4]


def test_vectors_exactly_at_the_threshold_are_near(spark):
    # a product of 46, squared lengths of 50 and 50: 0.92, of which two roots of 50 make a little less
    ones = lambda at, minus=(): [-1.0 if i in minus else float(i in at) for i in range(52)]
    v = spark.createDataFrame([(1, ones(range(50))), (2, ones({*range(47), 50, 51}, {47}))], "id long, vec array<double>")
    assert [(r.files, r.similarity) for r in classify.duplicate_clusters(v).collect()] == [([1, 2], 0.92)]
