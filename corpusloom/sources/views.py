"""The given tables in the shapes that the operators work on: a tree of files, Markdown texts, telemetry, commits.

The tables have no paths, headings or telemetry types; these views derive them from ids and contents by fixed rules,
in Spark here and in SQL in `VIEWS`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories of documents by id; the last two are one that is not expected and the root.
FOLDERS = ["architecture", "api", "bugfix-log", "best-practices", "setup", "changelog", "tests", "notes", ""]
EXPECTED = FOLDERS[:7]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The same with one of the expected folders under another name.
RENAMED = ["moved" if x == "setup" else x for x in FOLDERS]


def files(docs: DataFrame, folders: list[str] = FOLDERS) -> DataFrame:
    """documents with rel_path."""
    folder = F.element_at(F.array(*map(F.lit, folders)), (F.col("doc_id") % len(folders) + 1).cast("int"))
    return docs.withColumn("rel_path", F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(F.lit("")), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md")))


def markdown(docs: DataFrame, folders: list[str] = FOLDERS) -> DataFrame:
    """files whose lines are turned into headings of three levels at fixed places: column md."""
    lines = F.split("text", "\n", -1)
    mark = lambda x, i: F.when(i == 0, F.concat(F.lit("# "), x)).when(i % 4 == 1, F.concat(F.lit("## "), x)).when(i % 7 == 3, F.concat(F.lit("### "), x)).otherwise(x)
    return files(docs, folders).withColumn("md", F.array_join(F.transform(lines, mark), "\n"))


def noted(docs: DataFrame, folders: list[str] = FOLDERS) -> DataFrame:
    """file, text, doc_id: markdown with a block of frontmatter before every fourth text, and one that nothing closes before the next."""
    i = F.col("doc_id")
    status = F.element_at(F.array(F.lit("active"), F.lit("draft"), F.lit("superseded")), (i % 3 + 1).cast("int"))
    head = F.concat(F.lit("---\nid: doc-"), i.cast("string"), F.lit("\nstatus: "), status, F.lit("  # state\nowner: \""), "source", F.lit("\"\n" + BLOCK + "---\n"))
    text = F.when(i % 4 == 0, F.concat(head, "md")).when(i % 4 == 1, F.concat(F.lit("---\nstatus: open\n"), "md")).otherwise(F.col("md"))
    return markdown(docs, folders).select(F.col("rel_path").alias("file"), text.alias("text"), "doc_id")


#: Frontmatter of all kinds of values.
BLOCK = "tags: [a, 'b c', null, ]\nsteps:\n  - one\n\n  - \"two\"\n  -\nempty:\n# a comment: x\ncount: -7\nflag: True\n  deeper: no\nreplaces: []\n"


def telemetry(events: DataFrame) -> DataFrame:
    """Usage events: project, ts, event_id, kind, tool, hit, found, fixed, blocking, baseline, actual."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    kind = F.when(F.col("event_type").isin("view", "click"), "search_result").when(F.col("event_type") == "error", "guardrail_report").otherwise("tool_call")
    tool = F.element_at(F.array(*map(F.lit, TOOLS)), (k % len(TOOLS) + 1).cast("int"))
    return events.select(
        (F.col("user_id") % 8).alias("project"), "ts", "event_id", "user_id", kind.alias("kind"), F.when(kind != "guardrail_report", tool).alias("tool"), F.when(kind == "search_result", F.col("value") > 5).alias("hit"),
        (k % 5).alias("found"), (k % 3).alias("fixed"), (k % 2).alias("blocking"), (F.col("value") * 2).alias("baseline"), F.col("value").alias("actual"),
    )


TOOLS = ["search_docs", "search_bugfixes", "search_by_type", "search_tests", "write_bugfix_summary", "write_api_doc", "write_setup_doc", "save_session_summary"]


def relation_texts(supplier: DataFrame) -> DataFrame:
    """A file with frontmatter for each supplier: it replaces its predecessor and depends on its nation and on a neighbour that may not exist."""
    key = F.col("s_suppkey")
    status = F.element_at(F.array(F.lit("active"), F.lit("superseded"), F.lit("deprecated"), F.lit("draft")), (key % 4 + 1).cast("int"))
    text = F.concat(
        F.lit("---\nid: sup-"), key.cast("string"), F.lit("\ntype: "), F.when(key % 2 == 0, "'decision'").otherwise("note"), F.lit("\nstatus: "), status,
        F.lit("\nreplaces: [sup-"), (key - 1).cast("string"), F.lit("]\ndepends_on:\n  - nat-"), F.col("s_nationkey").cast("string"), F.lit("\n  - \"sup-"), (key + 7).cast("string"), F.lit("\"\n---\n# "), F.col("s_name"), F.lit("\n"),
    )
    return supplier.select(F.concat(F.lit("rel/"), F.lpad(key.cast("string"), 9, "0"), F.lit(".md")).alias("path"), text.alias("text"))


#: Folders, stems and extensions of source files by id.
CODE_FOLDERS = ["src", "lib/node_modules", ".cache", "app/core", "docs", "web", "assets"]
CODE_STEMS = ["main", "utils", "user_service", "test_models", "setup", "error_map", "tables", "server"]
CODE_EXTENSIONS = ["py", "ts", "js", "sql", "yaml", "md", "png", "pyi", "mjs"]


def sources(docs: DataFrame) -> DataFrame:
    """doc_id, path, size, text: each document's lines turned into the statements of a source file, in turn an import, a function, a class and a private name.

    The last folder holds no code, every third file begins with a comment on itself.
    """
    i, lines = F.col("doc_id"), F.split("text", "\n", -1)
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    kind = F.when(i % 7 == 6, F.lit("sql")).otherwise(pick(CODE_EXTENSIONS, F.floor(i / 8) % 9))
    path = F.concat_ws("/", pick(CODE_FOLDERS, i % 7), F.concat(pick(CODE_STEMS, i % 8), F.lit("_"), i.cast("string"), F.lit("."), kind))

    def written_as(own: list[str]) -> Column:
        line = lambda x, j: F.element_at(F.array(*[F.replace(F.replace(F.lit(t), F.lit("#"), j.cast("string")), F.lit("$"), F.length(x).cast("string")) for t in own]), j % 4 + 1)
        return F.array_join(F.transform(lines, line), "\n")

    head = F.when(i % 3 == 0, F.concat(F.lit('"""From '), "source", F.lit('."""\n'))).otherwise(F.lit(""))
    text = F.when(kind.isin("py", "pyi"), F.concat(head, written_as(PYTHON_LINES))).when(kind.isin("ts", "js", "mjs"), written_as(SCRIPT_LINES)).otherwise(F.col("text"))
    return docs.where("text IS NOT NULL").select("doc_id", path.alias("path"), text.alias("text")).withColumn("size", F.octet_length("text"))


#: A line of a document by its number modulo 4; `#` stands for the number, `$` for the line's length.
PYTHON_LINES = ["import m#", "def fn_#(x):\n    return $", 'class K#:\n    """Holds $ signs."""', 'async def _own_#():\n    """Own."""\n    return 0']
SCRIPT_LINES = ["import { a# } from './m#'", "export async function fn#(x) { return $ }", "/** Holds $\n * signs. */\nclass K# {}", "const _own# = $"]

_FOLDERS = "[" + ", ".join(f"'{x}'" for x in FOLDERS) + "]"
_TOOLS = "[" + ", ".join(f"'{x}'" for x in TOOLS) + "]"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _lines_sql(own: list[str]) -> str:
    return "array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: replace(replace(CASE (j - 1) % 4 " + " ".join(f"WHEN {k} THEN {_literal(t)}" for k, t in enumerate(own)) + " END, '#', (j - 1)::VARCHAR), '$', length(x)::VARCHAR)), chr(10))"


_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
#: The same in SQL, as common table expressions.
VIEWS = {
    "code_v": f"""code_v AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines, CASE WHEN doc_id % 7 = 6 THEN 'sql' ELSE {_list(CODE_EXTENSIONS)}[doc_id // 8 % 9 + 1] END AS ext, {_list(CODE_STEMS)}[doc_id % 8 + 1] || '_' || doc_id AS stem, {_list(CODE_FOLDERS)}[doc_id % 7 + 1] AS folder, folder || '/' || stem || '.' || ext AS path,
      CASE WHEN ext IN ('py', 'pyi') THEN CASE WHEN doc_id % 3 = 0 THEN '\"\"\"From ' || source || '.\"\"\"' || chr(10) ELSE '' END || {_lines_sql(PYTHON_LINES)} WHEN ext IN ('ts', 'js', 'mjs') THEN {_lines_sql(SCRIPT_LINES)} ELSE text END AS code FROM documents WHERE text IS NOT NULL)""",
    "docs_v": f"docs_v AS (SELECT *, {_FOLDERS}[doc_id % 9 + 1] AS folder, CASE WHEN folder <> '' THEN folder || '/' ELSE '' END || source || '-' || doc_id || '.md' AS rel_path FROM documents)",
    "md_v": "md_v AS (SELECT *, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i = 1 THEN '# ' || x WHEN (i - 1) % 4 = 1 THEN '## ' || x WHEN (i - 1) % 7 = 3 THEN '### ' || x ELSE x END), chr(10)) AS md FROM docs_v)",
    "fm_v": f"""fm_v AS (SELECT doc_id, rel_path AS file, CASE doc_id % 4 WHEN 0 THEN '---' || chr(10) || 'id: doc-' || doc_id || chr(10) || 'status: ' || ['active', 'draft', 'superseded'][doc_id % 3 + 1] || '  # state' || chr(10) || 'owner: "' || source || '"' || chr(10) || {_literal(BLOCK)} || '---' || chr(10) || md
      WHEN 1 THEN '---' || chr(10) || 'status: open' || chr(10) || md ELSE md END AS text FROM md_v)""",
    "tele_v": f"""tele_v AS (SELECT user_id % 8 AS project, ts, event_id, user_id, CASE WHEN event_type IN ('view', 'click') THEN 'search_result' WHEN event_type = 'error' THEN 'guardrail_report' ELSE 'tool_call' END AS kind,
      CASE WHEN kind <> 'guardrail_report' THEN {_TOOLS}[k % {len(TOOLS)} + 1] END AS tool, CASE WHEN kind = 'search_result' THEN value > 5 END AS hit, k % 5 AS found, k % 3 AS fixed, k % 2 AS blocking, value * 2 AS baseline, value AS actual
      FROM (SELECT *, coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events))""",
    "rel_v": """rel_v AS (SELECT 'rel/' || lpad(s_suppkey::VARCHAR, 9, '0') || '.md' AS path, 'sup-' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'decision' ELSE 'note' END AS type,
      ['active', 'superseded', 'deprecated', 'draft'][s_suppkey % 4 + 1] AS status, ['sup-' || (s_suppkey - 1)] AS replaces, ['nat-' || s_nationkey, 'sup-' || (s_suppkey + 7)] AS depends_on FROM supplier)""",
}


def sql(body: str, *views: str) -> str:
    """A query over the named views; a body that begins with a comma adds further ones."""
    below = {"fm_v": ["md_v", "docs_v"], "md_v": ["docs_v"]}
    wanted = {*views, *[x for v in views for x in below.get(v, [])]}
    need = [v for v in VIEWS if v in wanted]
    head = "WITH " + ", ".join(VIEWS[v] for v in need) if need else ""
    return f"{head} {body}"
