"""Document quality: rules that yield issues (severity, rule, file, message), the score, and the gate on ingestion."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import frontmatter, frontmatter_entries, meaningful_text, stripped, without_fences, without_frontmatter

#: What an issue costs and at most costs, by severity; sections by folder; known keys and states.
PENALTIES = {"critical": (10, 60), "warning": (2, 30), "info": (0, 0)}
REQUIRED = {"bugfix-log": ["Root Cause", "Solution", "Lesson Learned"], "tests": ["Scenario", "Steps", "Expected Result"]}
KNOWN_KEYS = ["id", "type", "status", "superseded_at", "replaces", "depends_on", "fixes", "implements"]
VALID_STATUS = ["active", "superseded", "deprecated"]
SHORT, THIN, THIN_SECTION = 30, 100, 20


def _levels(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(without_fences(without_frontmatter(text)), F.lit(r"(?m)^(#{1,6})\s"), F.lit(1)), F.length)


def headings(files: DataFrame) -> DataFrame:
    """file, n, levels (of the headings outside frontmatter and fences, in order) of files (file, text)."""
    return files.select("file", _levels(F.col("text")).alias("levels")).withColumn("n", F.size("levels"))


def first_jump(levels: Column) -> Column:
    """struct(at, level, above): the first heading of a level not seen before while none is one level above it, and the deepest one above; null without one.

    One fold over the headings: the levels seen are bits of a number. A heading that follows deeper ones only is no jump.
    """
    none = F.lit(None).cast("struct<at: int, level: int, above: int>")
    begin = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("at"), none.alias("jump"))

    def step(a: Column, level: Column) -> Column:
        below = F.greatest(*[F.when((level > k) & (F.getbit(a["seen"], F.lit(k)) == 1), F.lit(k)).otherwise(F.lit(0)) for k in range(1, 7)])
        is_jump = a["jump"].isNull() & (F.getbit(a["seen"], level) == 0) & (below > 0) & (below < level - 1)
        found = F.when(is_jump, F.struct(a["at"].alias("at"), level.alias("level"), below.alias("above"))).otherwise(a["jump"])
        return F.struct(a["seen"].bitwiseOR(F.pow(F.lit(2), level).cast("int")).alias("seen"), (a["at"] + 1).alias("at"), found.alias("jump"))

    return F.aggregate(levels, begin, step, lambda a: a["jump"])


def heading_jumps(files: DataFrame) -> DataFrame:
    """file, at, level of each file's first jump."""
    j = headings(files).select("file", first_jump(F.col("levels")).alias("j")).where("j IS NOT NULL")
    return j.select("file", "j.at", "j.level")


def thin_sections(text: Column) -> Column:
    """The headings of second-level sections outside fences that say less than THIN_SECTION characters."""
    bare = without_fences(text)
    heads = F.regexp_extract_all(bare, F.lit(r"(?m)^##[ \t]+([^\n]+)$"), F.lit(1))
    bodies = F.slice(F.split(bare, r"(?m)^##[ \t]+[^\n]+$", -1), F.lit(2), F.size(heads))
    said = F.zip_with(heads, bodies, lambda h, b: F.struct(stripped(F.regexp_replace(h, "^#+", "")).alias("heading"), F.length(meaningful_text(b)).alias("n")))
    return F.transform(F.filter(said, lambda x: x["n"] < THIN_SECTION), lambda x: x["heading"])


def has_section(text: Column, name: str) -> Column:
    return text.rlike(rf"(?im)^##\s+[*_\s]*(?:\S+\s+)?{name}")


def _issue(severity: str, rule: str, message: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), message.alias("message"))


#: The rules of which a broken one keeps a file out of an index.
CRITICAL = ("R9", "R10")


def content_issues(files: DataFrame, whole: bool = False, rules: tuple[str, ...] | None = None) -> DataFrame:
    """file, severity, rule, message of the rules on length, headings, sections and frontmatter of Markdown files (file, text).

    A README one folder down is a placeholder and exempt. With whole, as for a report on all files, READMEs at any depth
    are, a text's length includes its frontmatter, and neither tests' sections nor frontmatter is looked at. Each file is
    read once: all rules fill one array. rules: only these are looked at, and what others need isn't worked out.
    """
    want = lambda *names: rules is None or bool(set(names) & set(rules))
    readme = F.regexp_extract("file", r"([^/]+)$", 1) == "README.md"
    depth = F.size(F.split("file", "/"))
    f = files.where(F.col("file").endswith(".md") & ~(readme & (depth > 1 if whole else depth == 2)))
    text = F.col("text")
    body = text if whole else without_frontmatter(text)
    f = f.select("file", "text", *[F.length(meaningful_text(body)).alias("chars")] * want("R4", "R5"), *[_levels(text).alias("levels")] * want("R6", "R7", "R8"))
    if want("R8"):
        f = f.withColumn("jump", first_jump(F.col("levels")))
    empty = F.array().cast("array<struct<severity: string, rule: string, message: string>>")
    found = []
    if want("R4", "R5"):
        n = F.col("chars").cast("string")
        found.append(F.when(F.col("chars") < SHORT, _issue("warning", "R4", F.concat(F.lit("very short: "), n))).when(F.col("chars") < THIN, _issue("info", "R5", F.concat(F.lit("short: "), n))))
    if want("R6", "R7"):
        level = F.get("levels", F.lit(0))
        found.append(F.when(F.size("levels") == 0, _issue("info", "R6", F.lit("no headings"))).when(level > 1, _issue("info", "R7", F.concat(F.lit("first heading has level "), level.cast("string")))))
    if want("R8"):
        found.append(F.when(F.col("jump").isNotNull(), _issue("info", "R8", F.concat(F.lit("jump from level "), F.col("jump.above").cast("string"), F.lit(" to level "), F.col("jump.level").cast("string")))))
    issues = F.array_compact(F.array(*found)) if found else empty
    for (folder, names), rule in zip(REQUIRED.items(), CRITICAL, strict=True):
        if whole and folder != "bugfix-log" or not want(rule, "R11"):
            continue
        missing = F.array_compact(F.array(*[F.when(~has_section(text, s), _issue("critical", rule, F.lit(f"missing section {s}"))) for s in names])) if want(rule) else empty
        thin = F.transform(thin_sections(text), lambda h: _issue("warning", "R11", F.concat(F.lit("thin section "), h))) if want("R11") else empty
        issues = F.concat(issues, F.when(F.col("file").startswith(f"{folder}/"), F.concat(missing, thin)).otherwise(empty))
    if not whole and want("R12", "R13"):
        entries = F.coalesce(frontmatter_entries(frontmatter(text)), F.array().cast("array<struct<key: string, kind: string, value: string, items: array<string>>>"))
        unknown = F.transform(F.array_except(F.transform(entries, lambda x: x["key"]), F.array(*map(F.lit, KNOWN_KEYS))), lambda k: _issue("info", "R12", F.concat(F.lit("unknown key "), k)))
        status = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(entries, lambda x: x["key"] == "status"), lambda x: x["value"])), -1)
        bad = F.when(status.isNotNull() & ~status.isin(VALID_STATUS), F.array(_issue("warning", "R13", F.concat(F.lit("status "), status)))).otherwise(empty)
        issues = F.concat(issues, unknown, bad)
    out = f.select("file", F.explode(issues).alias("i")).select("file", "i.severity", "i.rule", "i.message")
    return out if rules is None else out.where(F.col("rule").isin(*rules))


def check_content(texts: DataFrame) -> DataFrame:
    """The rules on single files for texts that are no files yet (key, category, text), as if they stood in the category's folder: key, severity, rule, message."""
    folder = F.when(F.col("category") == "bugfix", "bugfix-log").when(F.col("category") == "test", "tests").otherwise(F.col("category"))
    f = texts.select(F.concat(folder, F.lit("/"), F.col("key").cast("string"), F.lit(".md")).alias("file"), "text")
    key = F.regexp_extract("file", r"([^/]*)\.md$", 1)
    return content_issues(f).select(key.alias("key"), "severity", "rule", "message")


def tree_issues(files: DataFrame, expected: list[str]) -> DataFrame:
    """Rules on the tree: expected folders without files, no README at the root, stray files at the root, folders not expected."""
    spark = files.sparkSession
    row = lambda d, severity, rule, message: d.select("file", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), message.alias("message"))
    folder = F.when(F.col("file").contains("/"), F.regexp_extract("file", r"^([^/]+)/", 1))
    f = files.select("file", folder.alias("folder"))
    want = spark.createDataFrame([(x,) for x in expected], "folder string")
    absent = want.join(f.select("folder").distinct(), "folder", "left_anti").withColumn("file", F.col("folder"))
    root = f.agg(F.count_if(F.col("file") == "README.md").alias("n")).where("n = 0").withColumn("file", F.lit("README.md"))
    stray = f.where(F.col("folder").isNull() & (F.col("file") != "README.md"))
    other = f.where(F.col("folder").isNotNull() & ~F.col("folder").isin(expected))
    return (
        row(absent, "info", "R2", F.lit("no files")).unionByName(row(root, "warning", "R3", F.lit("no README at the root")))
        .unionByName(row(stray, "info", "R15", F.lit("stray file at the root"))).unionByName(row(other, "info", "R16", F.concat(F.lit("folder not expected: "), "folder")))
    )


def missing_folder(spark: SparkSession, folder: str) -> DataFrame:
    """file, severity, rule, message: one critical issue if there is no such folder, else none. A corpus without a folder scores 0."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").limit(0).collect()
        rows = []
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = [(folder, "critical", "R1", "no such folder")]
    return spark.createDataFrame(rows, "file string, severity string, rule string, message string")


def score(issues: DataFrame) -> DataFrame:
    """n_critical, n_warning, n_info, score: one row, also without issues."""
    n = {s: F.count_if(F.col("severity") == s) for s in PENALTIES}
    lost = sum((F.least(n[s] * p, F.lit(cap)) for s, (p, cap) in PENALTIES.items()), F.lit(0))
    if "rule" in issues.columns:
        lost = F.when(F.count_if(F.col("rule") == "R1") > 0, F.lit(100)).otherwise(lost)
    return issues.agg(*[n[s].alias(f"n_{s}") for s in PENALTIES], F.greatest(F.lit(0), F.lit(100) - lost).cast("long").alias("score"))


def gate(files: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files without critical issues, and the rest with reasons (joined by "; ")."""
    critical = issues.where("severity = 'critical'")
    why = critical.groupBy("file").agg(F.array_join(F.sort_array(F.collect_list("message")), "; ").alias("reasons"))
    return files.join(critical, "file", "left_anti"), why


def report(issues: DataFrame, project: str, most: int = 50) -> DataFrame:
    """pos, line: a report in Markdown as rows: score, counts, and the first `most` issues, worst first. The issues that show are chosen before they are ordered."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    s = score(issues).select(F.posexplode(F.array(
        F.concat(F.lit("**Quality "), F.col("score").cast("string"), F.lit(f"/100** ({project})")),
        F.concat(F.lit("Critical: "), F.col("n_critical").cast("string"), F.lit(", warnings: "), F.col("n_warning").cast("string"), F.lit(", notes: "), F.col("n_info").cast("string")),
    )).alias("pos", "line"))
    shown = issues.withColumn("at", rank).orderBy("at", "file", "rule", "message").limit(most)
    # at most `most` rows meet in one array
    lines = shown.agg(F.array_sort(F.collect_list(F.struct("at", "file", "rule", "message", "severity"))).alias("x"))
    rows = lines.select(F.posexplode(F.transform("x", lambda i: F.concat(F.lit("- ["), i["severity"], F.lit("] **"), i["file"], F.lit("**: "), i["message"]))).alias("pos", "line"))
    return s.unionByName(rows.withColumn("pos", F.col("pos") + 2))


def index_report(chunks: DataFrame, project: str) -> DataFrame:
    """pos, line: how many chunks there are in all and of each type (type), the most frequent first. Types are few."""
    n = chunks.groupBy("type").agg(F.count("*").alias("n"))
    by = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "type"))), lambda x: F.concat(F.lit("- "), x["type"], F.lit(": "), (-x["minus"]).cast("string")))
    head = F.array(F.lit(f"**Index** ({project})"), F.concat(F.lit("Chunks: "), F.coalesce(F.sum("n"), F.lit(0)).cast("string")))
    return n.agg(F.concat(head, by).alias("lines")).select(F.posexplode("lines").alias("pos", "line"))
