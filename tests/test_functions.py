import pytest
from pyspark.sql import functions as F

from corpusloom.functions import paths, text


def rows(spark, values, **cols):
    d = spark.createDataFrame([(v,) for v in values], "x string")
    return [r.asDict(recursive=True) for r in d.select("x", *[c(F.col("x")).alias(k) for k, c in cols.items()]).collect()]


def test_document_types(spark):
    want = {
        "bugfix-log/a.md": "bugfix", "x/bug-fix-1.md": "bugfix", "best-practices/b.md": "best-practice", "api/users.md": "api", "architecture/c.md": "architecture", "CHANGELOG.md": "changelog", "release-notes.md": "changelog",
        "setup/d.md": "setup", "installation.md": "setup", "README.md": "readme", "tests/e.md": "test", "notes/f.md": "docs", "notes/about-apiary.md": "api",
    }
    assert {r["x"]: r["t"] for r in rows(spark, want, t=paths.doc_type)} == want


@pytest.mark.parametrize(
    ("path", "category", "confidence"),
    [("notes/about-apiary.md", "docs", 0.0), ("api/endpoints/users.md", "api", 0.92), ("bug-fix/fix.md", "bugfix", 0.92), ("ops/install-guide.md", "setup", 0.87), ("best-practices/x.md", "best-practice", 0.75), ("", "docs", 0.0)],
)
def test_path_hints(spark, path, category, confidence):
    h = rows(spark, [path], h=paths.path_hint)[0]["h"]
    assert h["category"] == category
    assert h["confidence"] == pytest.approx(confidence)


def test_keyword_hints_prefer_the_better_and_then_the_earlier(spark):
    got = [r["k"] for r in rows(spark, ["The root cause and its solution", "an error with a trace and a fix", "nothing here", None, "rest over http and install setup"], k=paths.keyword_hint)]
    assert [g and (g["category"], g["confidence"]) for g in got] == [("bugfix-log", 0.5), ("bugfix-log", 0.75), None, None, ("api", 0.5)]


def test_consensus(spark):
    d = spark.sql("""SELECT * FROM VALUES (1, struct('bugfix', 1.0D), struct('x', 0.5D), NULL), (2, struct('docs', 0.0D), struct('api', 0.5D), NULL),
      (3, struct('docs', 0.0D), NULL, NULL), (4, struct('docs', 0.0D), struct('api', 0.5D), struct('api', 0.5D)), (5, struct('docs', 0.0D), NULL, struct('setup', 0.5D)) AS t(i, p, k, e)""")
    t = "struct<category: string, confidence: double>"
    c = paths.consensus(F.col("p").cast(t), F.col("k").cast(t), F.col("e").cast(t))
    got = {r["i"]: (r["c"]["category"], round(r["c"]["confidence"], 4)) for r in d.select("i", c.alias("c")).collect()}
    assert got == {1: ("bugfix-log", 0.95), 2: ("api", 0.65), 3: ("docs", 0.3), 4: ("api", 0.9), 5: ("setup", 0.35)}


def test_slugs(spark):
    r = rows(spark, ["  Héllo, World! 2 ", "A" * 80], a=text.slug, b=lambda c: text.slug(c, "_"), v=text.version_slug)
    assert (r[0]["a"], r[0]["b"], r[0]["v"]) == ("h-llo-world-2", "h_llo_world_2", "llo-orld-2")
    assert len(r[1]["a"]) == 60


def test_identity_and_counts(spark):
    import hashlib

    r = rows(spark, ["a b\tc"], i=lambda c: text.chunk_id(F.lit("s"), c), h=text.content_hash, n=text.word_count)[0]
    assert r["i"] == hashlib.sha256(b"s\na b\tc").hexdigest()[:16]
    assert r["h"] == hashlib.md5(b"a b\tc").hexdigest()
    assert r["n"] == 3


def test_tokens_keep_letters_of_all_scripts_and_drop_stop_words(spark):
    assert rows(spark, ["The Straße is a_b, x 12 é"], t=text.tokens)[0]["t"] == ["straße", "a_b", "12"]


def test_meaningful_text(spark):
    want = {
        "# T\n\n- **bold** item\n> quote\n```\ncode\n```\n---\n1. [link](http://x) and `c`\n": "bold item\nquote\n\nlink and c".replace("\n\n", "\n"),
        "-   many blanks\n  12.  ordered": "many blanks\nordered",
        "> > nested\n>deep": "nested\ndeep",
        "a *b\nc* d": "a b\nc d",
        "snake_case_name __x__": "snakecasename x",
        "##no heading\n#  yes": "##no heading",
        "  * * *\n  ***  \nx": "x",
        "````": "",
        "[a\nb](c\nd)": "a\nb",
    }
    assert {r["x"]: r["m"] for r in rows(spark, want, m=text.meaningful_text)} == want


def test_frontmatter_values(spark):
    block = "id: adr-1\nstatus: 'active' # now\nnone: ~\nflag: TRUE\ncount: -12\nflow: [a, \"b\", , null]\nempty: []\nlist:\n  - x\n\n\t- 'y'\n  -\nover: 1\n# note: 2\n  inner: 3\nno colon here\nover: 2"
    got = rows(spark, [block, "", None], e=text.frontmatter_entries)
    assert [(e["key"], e["kind"], e["value"], e["items"]) for e in got[0]["e"]] == [
        ("id", "str", "adr-1", []), ("status", "str", "active", []), ("none", "null", None, []), ("flag", "bool", "TRUE", []), ("count", "int", "-12", []), ("flow", "list", None, ["a", "b"]), ("empty", "list", None, []),
        ("list", "list", None, ["x", "y", ""]), ("over", "int", "1", []), ("over", "int", "2", []),
    ]
    assert got[1]["e"] == [] and got[2]["e"] is None


def test_frontmatter(spark):
    doc = "---\nid: 'adr-1'\nstatus: active # now\nsuperseded_at: ~\nreplaces: [a, \"b\"]\ndepends_on:\n  - c0\n  - d\nfixes: e\n---\nbody"
    r = rows(spark, [doc, "no block"], b=text.frontmatter, rest=text.without_frontmatter)
    assert r[0]["rest"] == "body"
    assert r[1]["b"] is None
    b = rows(spark, [r[0]["b"]], id=lambda c: text.frontmatter_scalar(c, "id"), s=lambda c: text.frontmatter_scalar(c, "status"), n=lambda c: text.frontmatter_scalar(c, "superseded_at"),
             l1=lambda c: text.frontmatter_list(c, "replaces"), l2=lambda c: text.frontmatter_list(c, "depends_on"), l3=lambda c: text.frontmatter_list(c, "fixes"), l4=lambda c: text.frontmatter_list(c, "implements"))[0]
    assert (b["id"], b["s"], b["n"], b["l1"], b["l2"], b["l3"], b["l4"]) == ("adr-1", "active", None, ["a", "b"], ["c0", "d"], ["e"], [])


def test_documentability(spark):
    d = spark.createDataFrame([("src/main.py", True, 5, 3), ("src/none.py", False, 0, 0), ("src/user_service.py", False, 0, 0), ("a/Big_Handler_x.ts", True, 50, 50)], "path string, d boolean, i int, p int")
    assert [r[0] for r in d.select(paths.documentability(F.col("path"), F.col("d"), F.col("i"), F.col("p"))).collect()] == [7.8, 0.0, 2.0, 10.0]


def test_source_hints(spark):
    want = {"supabase/functions/x.ts": "api", "Dockerfile": "setup", "src/test_x.py": "tests", "a/conf.yaml": "setup", "db/x.sql": "architecture", "docs/x.md": "architecture", "x.md": None, "src/userroutes.py": "api", "src/string_utils.py": "best-practices", "src/retry_all.py": "bugfix-log", "src/zebra.py": None}
    assert {r["x"]: r["h"] for r in rows(spark, want, h=paths.source_hint)} == want


def test_rounding_is_half_up_on_the_value(spark):
    d = spark.createDataFrame([(0.125,), (-0.125,), (2.0,)], "x double")
    assert [r[0] for r in d.select(text.rounded(F.col("x"), 2)).collect()] == [0.13, -0.12, 2.0]


def test_documents_are_rendered_if_whole(spark):
    from corpusloom.functions import render

    d = spark.createDataFrame([("A bug!", "why", "how", "next"), ("B", "why", " ", "next")], "t string, a string, b string, c string")
    got = d.select(render.document("bugfix", F.col("t"), F.lit("2024-05-01"), tags=F.lit("x, y"), root_cause=F.col("a"), solution=F.col("b"), lesson_learned=F.col("c")).alias("d")).collect()
    assert got[0].d.path == "bugfix-log/2024-05-01-a-bug.md"
    head = "---\nid: {}\ntype: {}\nstatus: active\nreplaces: []\ndepends_on: []\nfixes: []\nimplements: []\n---\n\n"
    assert got[0].d.text == head.format("bugfix-2024-05-01-a-bug", "bugfix") + "# A bug!\n\n**Date:** 2024-05-01  \n**Tags:** x, y  \n**Affected files:** \n\n## Root Cause\nwhy\n\n## Solution\nhow\n\n## Lesson Learned\nnext\n"
    assert got[1].d is None
    one = spark.range(1)
    log = one.select(render.document("changelog", F.lit("v1.0"), F.lit("2024-05-01")).alias("a"), render.document("changelog", F.lit("v1.0"), F.lit("2024-05-01"), fixed=F.lit("x")).alias("b")).first()
    assert log.a is None and log.b.path == "changelog/v1-0.md" and log.b.text.endswith("# v1.0\n\n**Date:** 2024-05-01\n\n## Fixed\nx\n")
    api = one.select(render.document("api", F.lit("Make User"), F.lit("d"), method=F.lit("POST"), endpoint=F.lit("/u"), request_schema=F.lit("r"), response_schema=F.lit("s")).alias("d")).first().d
    assert (api.path, api.text) == ("api/make-user.md", head.format("api-make-user", "api") + "# Make User\n\n**Endpoint:** `POST /u`\n\n## Request\nr\n\n## Response\ns\n")
    adr = one.select(render.document("architecture", F.lit("X"), F.lit("2024-05-01"), overview=F.lit("o"), decisions=F.lit("d"), trade_offs=F.lit("t")).alias("d")).first().d
    assert adr.path == "architecture/2024-05-01-x.md" and "\nid: adr-2024-05-01-x\n" in adr.text
    case = one.select(render.document("test", F.lit("X"), F.lit("2024-05-01"), scenario=F.lit("a"), steps=F.lit("b"), expected_result=F.lit("c"), status=F.lit("")).alias("d")).first().d
    assert case.path == "tests/2024-05-01-x.md" and "**Status:** pending  \n**Tags:** \n\n## Scenario\na\n" in case.text


def test_commits_become_documents(spark):
    from corpusloom.functions import render

    d = spark.createDataFrame([("fix(api): it", "fix", "0123456789", "api", ["a.py"], ""), ("chore: x", "chore", "", "", [], ""), ("perf: y", "perf", "", "", [], "less work")], "m string, k string, h string, s string, f array<string>, c string")
    got = {r.m: r.d for r in d.select("m", render.commit_document(F.col("m"), F.col("k"), F.lit("2024-05-01"), F.col("h"), F.col("s"), F.col("f"), F.col("c")).alias("d")).collect()}
    fix = got["fix(api): it"]
    assert fix.path == "bugfix-log/2024-05-01-fix-api-it.md"
    assert "**Commit:** `01234567`  \n**Scope:** api  \n**Affected files:** a.py\n\n## Root Cause\n" in fix.text
    assert got["chore: x"] is None
    assert "**Commit:** `unknown`  \n**Type:** perf  \n**Affected files:** —\n\n## What Changed\nless work\n" in got["perf: y"].text


def test_log_and_status_lines(spark):
    from corpusloom.functions import render

    r = rows(spark, ["h\x1fAnn\x1f2024-01-01\x1fsay", "h\x1fAnn\x1fx", ""], e=render.log_entry)
    assert [x["e"] and x["e"]["subject"] for x in r] == ["say", None, None]
    want = {" M docs/a.md": "docs/a.md", "?? \"docs/b c.md\"": "docs/b c.md", "R  docs/o.md -> docs/n.md": "docs/n.md", "A  src/x.py": None, "   ": None, "A  documents/x": None}
    assert {x["x"]: x["p"] for x in rows(spark, want, p=lambda c: render.status_path(c, "docs"))} == want


def test_names_paths_and_queries(spark):
    from corpusloom.functions import render

    r = rows(spark, ["src/payment/stripe-webhook.service.ts", "src/a.py", "b"], q=render.file_query)
    assert [x["q"] for x in r] == ["stripe-webhook service payment", "a", "b"]
    r = rows(spark, ["https://x.org/team/wiki-knowledge.git", "https://x.org/digit/", "git@x:y/bit.git"], n=render.project_name)
    assert [x["n"] for x in r] == ["wiki", "digit", "bit"]
    r = rows(spark, ["a/b.md", "../c", "/etc/x", "a/../b", "a..b/c"], i=render.inside)
    assert [x["i"] for x in r] == [True, False, False, False, True]


def test_plain_headings(spark):
    want = {"🔧 **Root** `Cause` ": "Root Cause", "_a_ ~b~ ✨": "a b", "plain": "plain"}
    assert {r["x"]: r["h"] for r in rows(spark, want, h=text.plain_heading)} == want


def test_items_of_a_block_list(spark):
    block = "steps:\n  - one\n  -\n  - null\n  - \"two\"\n  - ''\n  -  \nother: [a, , null, ~, 'b c']\nnone:\n"
    e = spark.range(1).select(text.frontmatter_entries(F.lit(block)).alias("e")).first().e
    assert [(x["key"], x["kind"], x["items"]) for x in e] == [("steps", "list", ["one", "", "None", "two", "", ""]), ("other", "list", ["a", "b c"]), ("none", "null", [])]
