"""Column functions over paths: document types, category hints with confidence, languages, and the consensus of hints.

The word lists are fixed values; their order is part of the meaning, as the first match wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings of a lower-case path that give a chunk's type.
TYPE_WORDS = [
    ("bugfix", ["bugfix", "bug-fix"]), ("best-practice", ["best-practice", "bestpractice"]), ("api", ["api"]), ("architecture", ["architect"]),
    ("changelog", ["changelog", "release"]), ("setup", ["setup", "install"]), ("readme", ["readme"]), ("test", ["test"]),
]
#: Tokens of a path that hint at a category: category, any of these, base confidence, any of these among the directories.
HINT_TOKENS = [
    ("bugfix", ["bugfix", "bugfixlog", "bugfixes"], 0.80, ["bugfix", "bugfixlog"]),
    ("best-practice", ["best", "practice"], 0.75, []),
    ("architecture", ["architecture", "architect", "architectural", "architectures"], 0.82, ["architecture"]),
    ("changelog", ["changelog", "release"], 0.78, ["changelog", "release"]),
    ("api", ["api", "apis", "endpoint", "endpoints"], 0.80, ["api", "apis", "endpoint", "endpoints"]),
    ("setup", ["setup", "install", "deployment", "deploy"], 0.75, ["setup", "install"]),
    ("test", ["test", "tests", "testing", "qa"], 0.78, ["test", "tests", "testing"]),
]
#: Groups of words that a text's beginning holds all of.
KEYWORDS = [
    ("bugfix-log", [["root cause", "solution"], ["bug", "fix"], ["error", "trace", "fix"]]),
    ("api", [["endpoint", "request"], ["endpoint", "response"], ["rest", "http"]]),
    ("architecture", [["architecture", "design"], ["system", "component", "diagram"], ["design decision"], ["technology stack"]]),
    ("setup", [["install", "setup"], ["deploy", "configuration"], ["docker", "compose"], ["environment", "variable"]]),
    ("changelog", [["version", "release"], ["changelog"], ["breaking change"]]),
    ("best-practices", [["best practice"], ["coding standard"], ["convention"], ["style guide"]]),
    ("tests", [["test case", "scenario"], ["test", "expected result"], ["regression test"]]),
]
#: Categories by their directories, and languages by extension.
DIRECTORIES = {"architecture": "architecture", "api": "api", "bugfix": "bugfix-log", "best-practice": "best-practices", "setup": "setup", "changelog": "changelog", "test": "tests"}
LANGUAGES = {"python": ["py", "pyi"], "typescript": ["ts", "tsx"], "javascript": ["js", "jsx", "mjs", "cjs"]}
#: Words that the stem of an entry point contains; those of a file's stem and markers within its path.
ENTRY_POINTS = ["main", "app", "index", "server", "router", "routes", "api", "handler", "controller", "service", "middleware", "gateway", "cli", "__main__"]
API_STEMS = ["route", "router", "routes", "handler", "controller", "endpoint", "api", "gateway", "service", "middleware", "main", "server", "app", "jump-host", "proxy"]
TEST_MARKS = ["test_", "_test", ".spec.", ".test.", "/tests/", "/test/", "/spec/"]
SETUP_WORDS = ["config", "settings", "env", "deploy", "docker", "makefile", "setup", "install", "migrate", "migration", "seed", "seed_"]
PRACTICE_WORDS = ["util", "utils", "helper", "helpers", "shared", "common", "lib", "types", "constants", "validators", "formatters"]
BUGFIX_WORDS = ["error", "exception", "retry", "fallback", "patch"]
CONTAINER_STEMS = ["dockerfile", "docker-compose", "compose"]
CHANGELOG_STEMS = ["changelog", "changes", "history", "releases", "release-notes"]
EXTENSIONS = {"setup": ["yml", "yaml", "toml", "env", "ini", "conf", "cfg", "properties", "dockerfile"], "architecture": ["sql", "prisma", "graphql", "gql", "proto"]}


def _any(of: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, of)


def doc_type(path: Column) -> Column:
    p = F.lower(path)
    return F.coalesce(*[F.when(_any([p.contains(w) for w in words]), F.lit(kind)) for kind, words in TYPE_WORDS], F.lit("docs"))


def path_hint(path: Column) -> Column:
    """struct(category, confidence) by the tokens of a path; those but the last count as directories."""
    tokens = F.filter(F.split(F.lower(path), r"[./_\\-]+"), lambda t: t != "")
    dirs = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
    holds = lambda where, words: F.arrays_overlap(where, F.array(*map(F.lit, words)))
    both = lambda where, a, b: F.array_contains(where, a) & F.array_contains(where, b)
    found = None
    for category, words, base, near in HINT_TOKENS:
        hit = holds(tokens, words)
        bonus = holds(dirs, near) if near else both(dirs, "best", "practice")
        if category == "bugfix":
            hit, bonus = hit | both(tokens, "bug", "fix"), bonus | both(dirs, "bug", "fix")
        value = F.struct(F.lit(category).alias("category"), F.least(F.lit(base) + F.when(bonus, 0.12).otherwise(0.0), F.lit(1.0)).alias("confidence"))
        found = F.when(hit, value) if found is None else found.when(hit, value)
    return found.otherwise(F.struct(F.lit("docs").alias("category"), F.lit(0.0).alias("confidence")))


def keyword_hint(text: Column) -> Column:
    """struct(category, confidence) by keywords in the first 2000 characters; null without any. Earlier ones win ties."""
    head = F.lower(F.left(text, F.lit(2000)))
    scores = []
    for at, (category, groups) in enumerate(KEYWORDS):
        best = F.greatest(*[F.when(reduce(lambda a, b: a & b, [head.contains(w) for w in g]), F.lit(min(0.25 * len(g), 0.9))).otherwise(F.lit(0.0)) for g in groups], F.lit(0.0))
        scores.append(F.struct(best.alias("confidence"), F.lit(-at).alias("rank"), F.lit(category).alias("category")))
    top = F.array_max(F.array(*scores))
    return F.when(top["confidence"] > 0, F.struct(top["category"].alias("category"), top["confidence"].alias("confidence")))


def long_name(category: Column) -> Column:
    """A category's directory, which is also its long name."""
    return F.coalesce(*[F.when(category == short, F.lit(long)) for short, long in DIRECTORIES.items()], category)


def consensus(path: Column, keyword: Column, embedding: Column) -> Column:
    """struct(category, confidence) of three hints, each a struct that may be null; `embedding` names categories by their long name."""
    from corpusloom.functions.text import rounded

    said = lambda c, x: F.struct(c.alias("category"), x.alias("confidence"))
    p, k, e = path["confidence"], keyword["confidence"], embedding["confidence"]
    docs = F.coalesce(path["category"], F.lit("docs")) == "docs"
    name = long_name(path["category"])
    return (
        F.when(~docs & (p >= 0.7), said(name, F.least(F.lit(0.75) + p * 0.2, F.lit(0.95))))
        .when(~docs & (p >= 0.45), said(name, F.lit(0.7)))
        .when(k.isNotNull() & (keyword["category"] == embedding["category"]), said(keyword["category"], F.least(F.lit(0.85) + e * 0.1, F.lit(0.95))))
        .when(k.isNotNull(), said(keyword["category"], F.lit(0.65)))
        .when(e > 0.4, said(embedding["category"], rounded(e * 0.7, 2)))
        .otherwise(said(F.lit("docs"), F.lit(0.3)))
    )


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(*[F.when(ext.isin(exts), F.lit(name)) for name, exts in LANGUAGES.items()], F.lit("other"))


def source_hint(path: Column) -> Column:
    """The category of a source file by its path; null where the path does not say."""
    p = F.lower(path)
    name = F.regexp_extract(p, r"([^/]+)$", 1)
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.([^.]+)$", 1)
    within = lambda words: _any([stem.contains(w) for w in words])
    return (
        F.when(p.contains("supabase/functions/"), "api")
        .when(stem.isin(CONTAINER_STEMS), "setup")
        .when(stem.isin(CHANGELOG_STEMS), "changelog")
        .when(_any([p.contains(m) for m in TEST_MARKS]), "tests")
        .when(ext.isin(EXTENSIONS["setup"]), "setup")
        .when(ext.isin(EXTENSIONS["architecture"]), "architecture")
        .when((ext == "md") & (p.startswith("docs/") | p.startswith("documentation/") | p.contains("/docs/") | p.contains("/documentation/")), "architecture")
        .when(ext == "md", F.lit(None).cast("string"))
        .when(stem.isin(API_STEMS) | _any([stem.startswith(w) | stem.endswith(w) for w in API_STEMS]), "api")
        .when(within(SETUP_WORDS), "setup")
        .when(within(PRACTICE_WORDS), "best-practices")
        .when(within(BUGFIX_WORDS), "bugfix-log")
    )


def documentability(path: Column, has_docstrings: Column, imports: Column, public: Column) -> Column:
    """How well worth documenting a source file is, 0 to 10."""
    from corpusloom.functions.text import rounded

    stem = F.lower(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))
    score = F.when(has_docstrings, 3.0).otherwise(0.0) + F.least(imports / 5.0, F.lit(2.0)) + F.least(public, F.lit(5)) * 0.6 + F.when(_any([stem.contains(w) for w in ENTRY_POINTS]), 2.0).otherwise(0.0)
    return rounded(F.least(score, F.lit(10.0)), 2)
