"""Column functions that render rows: documents of seven kinds with frontmatter, commit documents, warnings, queries for a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import slug, version_slug

#: Each kind's folder, whether its name is dated, its id's prefix, the lines that head it, and its sections (heading, field, required).
KINDS = {
    "bugfix": ("bugfix-log", True, "bugfix", ["date", "tags", "files"], [("Root Cause", "root_cause", True), ("Solution", "solution", True), ("Lesson Learned", "lesson_learned", True)]),
    "architecture": ("architecture", True, "adr", ["date"], [("Overview", "overview", True), ("Decisions", "decisions", True), ("Trade-offs", "trade_offs", True), ("Components", "components", False), ("Diagrams", "diagrams", False)]),
    "api": ("api", False, "api", ["endpoint"], [("Request", "request_schema", True), ("Response", "response_schema", True), ("Authentication", "auth", False), ("Examples", "examples", False)]),
    "best-practice": ("best-practices", False, "best-practice", [], [("Context", "context", True), ("Rule", "rule", True), ("Rationale", "rationale", True), ("Examples", "examples", False)]),
    "setup": ("setup", False, "setup", [], [("Prerequisites", "prerequisites", True), ("Steps", "steps", True), ("Verification", "verification", True), ("Troubleshooting", "troubleshooting", False)]),
    "changelog": ("changelog", False, "changelog", ["date"], [("Added", "added", False), ("Changed", "changed", False), ("Fixed", "fixed", False), ("Breaking Changes", "breaking", False)]),
    "test": ("tests", True, "test", ["date", "status", "tags"], [("Preconditions", "preconditions", False), ("Scenario", "scenario", True), ("Steps", "steps", True), ("Expected Result", "expected_result", True), ("Actual Result", "actual_result", False)]),
}
#: For each type of commit that is kept, its folder, the label of its files and its sections; the second one holds the change.
COMMITS = {
    "fix": ("bugfix-log", "Affected files", ["Root Cause", "Solution", "Lesson Learned"], 1),
    "feat": ("changelog", "Changed files", ["Summary", "Changes", "Impact"], 1),
    "refactor": ("best-practices", "Affected files", ["What Changed", "Pattern / Rationale", "When to Apply"], 0),
    "perf": ("best-practices", "Affected files", ["What Changed", "Pattern / Rationale", "When to Apply"], 0),
    "docs": ("architecture", "Changed files", ["Overview", "Decisions"], 0),
}
RELATIONS = ["replaces", "depends_on", "fixes", "implements"]
GENERIC_FOLDERS = ["src", "lib", "app", "components", "utils", "helpers", "common", "shared", ".", ""]


def emit_frontmatter(entity_id: Column, kind: Column, status: Column | None = None, **relations: Column) -> Column:
    """The canonical block: id, type, status and all relations in their order, as flow lists, and an empty line behind it."""
    lines = [F.concat(F.lit("id: "), entity_id), F.concat(F.lit("type: "), kind), F.concat(F.lit("status: "), F.lit("active") if status is None else status)]
    lines += [F.concat(F.lit(f"{name}: "), flow_list(relations[name]) if name in relations else F.lit("[]")) for name in RELATIONS]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"))


def flow_list(items: Column) -> Column:
    """[a, b], [] if there is none."""
    return F.concat(F.lit("["), F.coalesce(F.array_join(items, ", "), F.lit("")), F.lit("]"))


def _bold(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"**{label}:** "), value)


def document(kind: str, title: Column, day: Column, **fields: Column) -> Column:
    """struct(path, text) of a document; null where a required field is empty, or all fields are.

    Beside its sections a kind takes tags, files, status, or method and endpoint. A changelog's title is its version.
    """
    folder, dated, prefix, heads, sections = KINDS[kind]
    given = {f: F.nullif(F.trim(fields[f]), F.lit("")) if f in fields else F.lit(None).cast("string") for _, f, _ in sections}
    parts = [F.when(given[f].isNotNull(), F.concat(F.lit(f"## {h}\n"), given[f], F.lit("\n"))) for h, f, _ in sections]
    whole = F.coalesce(*[given[f] for _, f, _ in sections]).isNotNull()
    for _, f, required in sections:
        if required:
            whole = whole & given[f].isNotNull()
    said = lambda f, other="": F.coalesce(fields[f], F.lit(other)) if f in fields else F.lit(other)
    lines = {"date": _bold("Date", day), "tags": _bold("Tags", said("tags")), "files": _bold("Affected files", said("files")), "status": _bold("Status", F.coalesce(F.nullif(said("status"), F.lit("")), F.lit("pending"))),
             "endpoint": F.concat(F.lit("**Endpoint:** `"), said("method"), F.lit(" "), said("endpoint"), F.lit("`"))}
    own = slug(title) if kind != "changelog" else version_slug(title)
    name = F.concat(day, F.lit("-"), own) if dated else own
    head = [F.concat(F.concat_ws("  \n", *[lines[h] for h in heads]), F.lit("\n"))] if heads else []
    text = F.concat(emit_frontmatter(F.concat(F.lit(f"{prefix}-"), name), F.lit(kind)), F.concat_ws("\n", F.concat(F.lit("# "), title, F.lit("\n")), *head, *parts))
    return F.when(whole, F.struct(F.concat(F.lit(f"{folder}/"), name, F.lit(".md")).alias("path"), text.alias("text")))


def commit_document(message: Column, kind: Column, day: Column, commit: Column, scope: Column, files: Column, change: Column) -> Column:
    """struct(path, text) of the document that a commit of a known type is worth; null for other types. files: an array."""
    short = F.coalesce(F.nullif(F.left(commit, F.lit(8)), F.lit("")), F.lit("unknown"))
    scoped, listed = F.coalesce(F.nullif(scope, F.lit("")), F.lit("—")), F.when(F.size(files) > 0, F.array_join(files, ", ")).otherwise(F.lit("—"))
    found = F.lit(None).cast("struct<path: string, text: string>")
    for name, (folder, label, sections, holds) in COMMITS.items():
        lines = [_bold("Date", day), F.concat(F.lit("**Commit:** `"), short, F.lit("`"))]
        if name in ("fix", "feat"):
            lines.append(_bold("Scope", scoped))
        if name in ("refactor", "perf"):
            lines.append(_bold("Type", F.concat(F.lit(name), F.when(scoped != "—", F.concat(F.lit(" ("), scoped, F.lit(")"))).otherwise(F.lit("")))))
        lines.append(_bold(label, listed))
        told = F.coalesce(F.nullif(change, F.lit("")), F.concat(F.lit("The whole change is in commit `"), short, F.lit("`.")))
        body = [F.concat(F.lit(f"## {h}\n"), told if i == holds else F.lit("*To be written: this comes from a commit.*"), F.lit("\n")) for i, h in enumerate(sections)]
        text = F.concat(F.lit("# "), message, F.lit("\n\n"), F.concat_ws("  \n", *lines), F.lit("\n\n"), F.concat_ws("\n", *body))
        path = F.concat(F.lit(f"{folder}/"), day, F.lit("-"), slug(message), F.lit(".md"))
        found = F.when(F.lower(kind) == name, F.struct(path.alias("path"), text.alias("text"))).otherwise(found)
    return found


def file_query(path: Column) -> Column:
    """Search words for a file: its stem, dots as spaces, and its folder unless that is generic."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.when(name.rlike(r"^.+\."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    parent = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    return F.trim(F.concat(F.replace(stem, F.lit("."), F.lit(" ")), F.lit(" "), F.when(parent.isin(GENERIC_FOLDERS), F.lit("")).otherwise(parent)))


def project_name(url: Column) -> Column:
    """A repository's name by its address: the last segment without `.git` and `-knowledge`."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(url, r"/+$", ""), r"([^/]*?)(?:\.git)?$", 1), "-knowledge$", "")


def divergence_warning(state: Column, ahead: Column, behind: Column) -> Column:
    """What to tell a writer about a branch; null if all is well."""
    n = lambda c: c.cast("string")
    return (
        F.when(state == "diverged", F.concat(F.lit("diverged: "), n(ahead), F.lit(" commits are only here, "), n(behind), F.lit(" only there")))
        .when(state == "ahead", F.concat(n(ahead), F.lit(" commits are not on the remote")))
        .when(state == "no-upstream", "nothing is pushed anywhere")
    )


def commit_summary(prefix: str, n_files: Column, n_bugfix: Column, first: Column) -> Column:
    """One line for a commit of n_files files, n_bugfix of them bug fixes."""
    return F.concat(F.lit(f"{prefix}: "), F.when(n_files == 1, F.concat(F.lit("update "), first)).when(n_bugfix == n_files, F.concat(F.lit("add "), n_bugfix.cast("string"), F.lit(" bugfix summaries"))).otherwise(F.concat(F.lit("update "), n_files.cast("string"), F.lit(" files"))))


def inside(path: Column) -> Column:
    """Whether a relative path stays below its base."""
    return ~F.array_contains(F.split(path, "/"), "..") & ~path.startswith("/")


def title_case(folder: Column) -> Column:
    return F.initcap(F.replace(folder, F.lit("-"), F.lit(" ")))


def cascade(own: Column, default: Column) -> Column:
    """A project's setting, or the global one where it is null or empty."""
    return F.coalesce(F.nullif(own, F.lit("")), default)


def log_entry(line: Column) -> Column:
    """struct(hash, author, date, subject) of a line of a log whose four fields a unit separator parts; null for other lines."""
    p = F.split(line, "\x1f", -1)
    return F.when(F.size(p) == 4, F.struct(p[0].alias("hash"), p[1].alias("author"), p[2].alias("date"), p[3].alias("subject")))


def status_path(line: Column, prefix: str = "") -> Column:
    """The path that a line of a short status names: two signs, a blank, and a path; of a renamed or copied one the new path. Null for empty lines and, with prefix, for what lies elsewhere."""
    said = F.trim(F.substring(line, 4, 1 << 20))
    moved = F.trim(F.left(line, F.lit(2))).rlike("^[RC]") & said.contains(" -> ")
    path = F.regexp_replace(F.when(moved, F.regexp_replace(said, "^.*? -> ", "")).otherwise(said), '^"+|"+$', "")
    fine = F.trim(line) != ""
    return F.when(fine & ((path == prefix) | path.startswith(f"{prefix}/")) if prefix else fine, path)
