"""Source files: which of them to read, what they hold, and where documentation pays most."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import documentability, language, source_hint

MOST_BYTES = 500_000
#: Directories that hold no sources, and extensions of files that are none.
SKIPPED = [
    "node_modules", ".git", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", ".venv", "venv", "env", ".env",
    "vendor", "target", ".next", ".nuxt", "out", "coverage", ".tox", ".eggs", "*.egg-info",
]
SKIPPED_EXTENSIONS = [
    "pyc", "pyo", "pyd", "so", "dll", "dylib", "exe", "bin", "jpg", "jpeg", "png", "gif", "ico", "svg", "webp", "avif",
    "mp3", "mp4", "wav", "zip", "tar", "gz", "tgz", "lock", "sum", "woff", "woff2", "ttf", "eot", "map",
]
#: What declares a name, imports and documents in scripts.
SCRIPT_SYMBOL = r"(?:export\s+)?(?:async\s+)?(?:function|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)"
SCRIPT_IMPORT = r"(?m)^(?:import|require)\b"
SCRIPT_DOC = r"(?s)/\*\*\s*(.*?)\s*\*/"
SCRIPT_CHARS, DOC_CHARS, PREVIEW = 50_000, 10_000, 300
UNIT = "path string, symbols array<string>, docstring string, import_count int, public_functions int, has_docstrings boolean"


def source_files(files: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """files (path, size, ...) of sources: none in skipped or hidden directories, of skipped extensions or too large, nor with a part of the path that `ignored` (part) names."""
    parts = F.split("path", "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    out = files.where((F.col("size") <= MOST_BYTES) & ~F.arrays_overlap(dirs, F.array(*map(F.lit, SKIPPED))) & ~F.exists(dirs, lambda p: p.startswith(".")) & ~ext.isin(SKIPPED_EXTENSIONS))
    if ignored is None:
        return out
    part = F.regexp_replace(F.trim("part"), "/+$", "")
    names = ignored.where(~F.trim("part").startswith("#") & (part != "")).select(part.alias("part")).distinct()
    bad = out.select("path", F.explode(F.split("path", "/")).alias("part")).join(names, "part", "left_semi").select("path").distinct()
    return out.join(bad, "path", "left_anti")


def python_unit(text: str | None) -> tuple[list[str], str, int, int, bool]:
    """Symbols, first docstring, imports, public functions and whether there is a docstring, by the syntax tree; nothing if it doesn't parse.

    The tree is read level by level. The module's own docstring counts last.
    """
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return [], "", 0, 0, False
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    nodes = list(ast.walk(tree))
    named = [n for n in nodes if isinstance(n, (*functions, ast.ClassDef))]
    docs = [d for n in [*named, tree] if (d := ast.get_docstring(n))]
    symbols = [n.name if isinstance(n, functions) else f"class {n.name}" for n in named]
    public = sum(isinstance(n, functions) and not n.name.startswith("_") for n in named)
    return symbols, docs[0][:PREVIEW] if docs else "", sum(isinstance(n, ast.Import | ast.ImportFrom) for n in nodes), public, bool(docs)


def python_units(files: DataFrame) -> DataFrame:
    """path, symbols, docstring, import_count, public_functions, has_docstrings of Python sources (path, text). Syntax trees have no expression in SQL."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *python_unit(t)) for p, t in zip(f["path"], f["text"], strict=True)], columns=["path", "symbols", "docstring", "import_count", "public_functions", "has_docstrings"])

    return files.select("path", "text").mapInPandas(work, UNIT)


def script_units(files: DataFrame) -> DataFrame:
    """The same of JavaScript and TypeScript sources, by patterns over their beginnings: every declared name counts, exported or not."""
    head = F.left("text", F.lit(SCRIPT_CHARS))
    symbols = F.regexp_extract_all(head, F.lit(SCRIPT_SYMBOL), F.lit(1))
    plain = F.left(F.regexp_replace(F.regexp_replace(F.regexp_extract(F.left("text", F.lit(DOC_CHARS)), SCRIPT_DOC, 1), r"\s*\*\s*", " "), r"^\s+|\s+$", ""), F.lit(PREVIEW))
    f = files.select("path", symbols.alias("symbols"), plain.alias("docstring"), F.regexp_count(head, F.lit(SCRIPT_IMPORT)).alias("import_count"))
    return f.select("path", "symbols", "docstring", "import_count", F.size(F.filter("symbols", lambda x: ~x.startswith("_"))).alias("public_functions"), (F.col("docstring") != "").alias("has_docstrings"))


def units(files: DataFrame) -> DataFrame:
    """path, language, line_count, category (docs where the path does not say), score and the columns of python_units of each source file (path, text)."""
    f = files.select("path", "text", language(F.col("path")).alias("language"))
    none = f.where("language = 'other'").select("path", F.array().cast("array<string>").alias("symbols"), F.lit("").alias("docstring"), F.lit(0).alias("import_count"), F.lit(0).alias("public_functions"), F.lit(False).alias("has_docstrings"))
    parsed = python_units(f.where("language = 'python'")).unionByName(script_units(f.where("language IN ('typescript', 'javascript')"))).unionByName(none)
    lines = f.select("path", "language", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("line_count"))
    return scored(lines.join(parsed, "path"))


def scored(found: DataFrame) -> DataFrame:
    """found (path, has_docstrings, import_count, public_functions, ...) with category and score."""
    score = documentability(F.col("path"), F.col("has_docstrings"), F.col("import_count"), F.col("public_functions"))
    return found.withColumn("category", F.coalesce(source_hint(F.col("path")), F.lit("docs"))).withColumn("score", score)


def to_document(found: DataFrame, most: int = 20) -> DataFrame:
    """Of the `most` best scored units (equal ones by path) those in a known language, with their first five symbols."""
    best = found.orderBy(F.desc("score"), "path").limit(most)
    return best.where("language <> 'other'").select("path", "language", "score", "category", F.slice("symbols", 1, 5).alias("symbols"), "import_count", "line_count", "has_docstrings")


def distributions(found: DataFrame) -> DataFrame:
    """level, language, category, n: a count for each language, each category and in total, in one pass; the other columns are null."""
    return found.groupingSets([["language"], ["category"], []], "language", "category").agg(F.count("*").alias("n"), F.grouping_id().alias("level")).select("level", "language", "category", "n")


def ranked(counts: DataFrame) -> DataFrame:
    """distributions in the order of a report: by level, the most frequent first."""
    return counts.orderBy("level", F.desc("n"), "language", "category")


def totals(found: DataFrame) -> DataFrame:
    """total_files, total_lines, parsed_files: one row."""
    return found.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"), F.count_if(F.col("language") != "other").alias("parsed_files"))


def folder(path: Column) -> Column:
    """A path's folder, `.` at the root."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def undocumented(found: DataFrame) -> DataFrame:
    """folder: those that hold files, but none in a known language; the root doesn't count."""
    f = found.select(folder(F.col("path")).alias("folder"), "language")
    return f.groupBy("folder").agg(F.count_if(F.col("language") != "other").alias("n")).where("n = 0 AND folder <> '.'").select("folder")


def first_folders(folders: DataFrame, most: int = 20) -> DataFrame:
    """The first `most` folders by name."""
    return folders.orderBy("folder").limit(most)
