"""Line dedup: winnowed line fingerprints find runs of lines that repeat; later ones are deleted.

A run counts if it has `min_lines` lines, or fewer with more than `many_words` words together.

1. Winnowing. A window is a run that counts, of `min_lines` lines at most; of its line hashes the least is its
   fingerprint (the last of equal ones). Lines that count alone hash below all others, so that a window which holds
   one needs no fingerprint besides. Only lines that are the fingerprint of some window are kept, one row each, with
   their position and the digests of the lines around it: equal windows have equal fingerprints at equal offsets, so
   no shared run that counts goes unseen.
2. Positions are joined by fingerprint, each with the first one by (id, line); those whose fingerprint stands nowhere
   else end there.
3. The match with the first position is extended line by line to the left and to the right, by the lines' 128-bit
   digests. What it covers of the position's windows is a later copy. Neighbouring fingerprints overlap, and so chain
   up to whole runs of any length.
4. Windows that the first position does not have may still stand at others that it differs from as well: these alone
   become rows, and the first of equal ones stays.
5. Each line of a later copy is deleted.

The lines around a position are read where the document is, and positions are written once. No pairs are made: each
position meets one other, in a sort-merge join that Spark can split, so that a line shared by a third of all
documents needs no task of its own.

A word is a stretch without white space. Nulls: a null text is empty; null ids sort first. Rows that
repeat id and text count as one document: they are edited alike. Two texts under one id are ordered by their digests.
Other columns pass through as they are, whatever their names. Empty texts have one empty line. Very long texts are
read whole; a document's lines are one array in its task. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import keyed, written

#: A run of fewer than `min_lines` lines counts if it has more words than this.
MANY_WORDS = 50
#: Stands for the digest of a line before or behind the text.
OUTSIDE = bytes(16)


def fingerprints(docs: DataFrame, min_lines: int, id_col: str = "doc_id", text_col: str = "text", many_words: int = MANY_WORDS) -> DataFrame:
    """doc, id, pos, fp, around, windows: the lines that are the fingerprint of a window.

    around: the digests of the line and of min_lines - 1 on either side, one behind the other (OUTSIDE beyond the text).
    windows: left * min_lines + right for each window, by how many lines it has before and after this one.
    """
    reach = min_lines - 1
    k = keyed(docs, id_col, text_col)
    # each line is digested and its words are counted once; only that goes on, and not the line
    said = lambda x: F.length(F.translate(F.regexp_replace(x, r"\S+", "x"), " \t\n\x0b\f\r", ""))
    k = k.select("doc", "id", F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.unhex(F.md5(x)).alias("d"), said(x).alias("w"))).alias("lines"))
    above = lambda x: F.xxhash64(x["d"]).bitwiseAND(F.lit((1 << 63) - 1))
    order = lambda x: F.when(x["w"] > many_words, above(x).bitwiseOR(F.lit(-(1 << 63)))).otherwise(above(x))
    k = k.select("doc", "id", F.transform("lines", lambda x: F.struct(x["d"].alias("d"), x["w"].alias("w"), order(x).alias("h"))).alias("lines"))
    none = F.array_repeat(F.lit(None).cast(k.schema["lines"].dataType.elementType), reach)
    k = k.select("doc", "id", F.size("lines").alias("n"), F.concat(none, "lines", none).alias("padded"))
    # column i holds the line i - reach places from the position; nulls outside the text
    near = [F.slice("padded", F.lit(i + 1), F.col("n")).alias(f"l{i}") for i in range(2 * reach + 1)]
    w = k.select("doc", "id", F.posexplode(F.arrays_zip(*near)).alias("pos", "x"))
    w = w.select("doc", "id", "pos", *[F.col(f"x.l{i}.{c}").alias(f"{c}{i}") for i in range(2 * reach + 1) for c in "dwh"])
    own = F.col(f"h{reach}")

    def window(left: int, right: int) -> Column:
        """The code of the window from `left` lines before to `right` behind, if it counts and this line is its fingerprint."""
        at = range(reach - left, reach + right + 1)
        there = F.col(f"h{at[0]}").isNotNull() & F.col(f"h{at[-1]}").isNotNull()
        if len(at) < min_lines:
            there &= reduce(Column.__add__, [F.col(f"w{i}") for i in at]) > many_words
        least = [own <= F.col(f"h{i}") if i < reach else own < F.col(f"h{i}") for i in at if i != reach]
        return F.when(reduce(Column.__and__, [there, *least]), F.lit(left * min_lines + right))

    windows = F.filter(F.array(*[window(left, n - left) for n in range(min_lines) for left in range(n + 1)]), lambda x: x.isNotNull())
    marks = w.withColumn("windows", windows).where("size(windows) > 0")
    return marks.select("doc", "id", "pos", own.alias("fp"), F.concat(*[F.coalesce(f"d{i}", F.lit(OUTSIDE)) for i in range(2 * reach + 1)]).alias("around"), "windows")


def extended(marks: DataFrame, min_lines: int) -> DataFrame:
    """doc, id, pos, left, right (how far the later copy reaches around the line; null: not one), rest (windows not in it), around (if there is a rest).

    One row for each of the fingerprints `marks`, which must be written, but the first of its kind.
    """
    reach = min_lines - 1
    at = F.struct("id", "doc", "pos")  # repeated rows are the same places again
    first = F.min(F.struct("id", "doc", "pos", "around"))
    seen = marks.groupBy("fp").agg(first.alias("first"), F.max(at).alias("last")).withColumn("begin", F.expr("struct(first.id, first.doc, first.pos)"))
    seen = seen.where("begin <> last").select("fp", "begin", F.col("first.around").alias("other"))
    # what is joined was written: then Spark splits a join at a line of very many places, which it can't behind an
    # aggregate; sorted and merged at any size, these joins are the same plan on little and on much
    met = marks.join(written(seen, "shared").hint("merge"), "fp").where(at != F.col("begin"))
    digest = lambda c, i: F.substring(c, 16 * i + 1, 16)
    same = [(digest("around", i) == digest("other", i)) & (digest("around", i) != F.lit(OUTSIDE)) for i in range(2 * reach + 1)]
    far = lambda steps: reduce(lambda n, x: F.when(x, n + 1).otherwise(0), reversed(steps), F.lit(0))
    met = met.withColumn("before", far(same[:reach][::-1])).withColumn("behind", far(same[reach + 1 :]))
    inside = lambda x: same[reach] & (F.floor(x / min_lines) <= F.col("before")) & (x % min_lines <= F.col("behind"))
    met = met.withColumn("hits", F.filter("windows", inside)).withColumn("rest", F.filter("windows", lambda x: ~inside(x)))
    # the windows of one fingerprint all hold its line: together they are one stretch
    left, right = F.array_max(F.transform("hits", lambda x: F.floor(x / min_lines).cast("int"))), F.array_max(F.transform("hits", lambda x: x % min_lines))
    return met.select("doc", "id", "pos", left.alias("left"), right.alias("right"), "rest", F.when(F.size("rest") > 0, F.col("around")).alias("around"))


def repeated_runs(docs: DataFrame, min_lines: int, id_col: str = "doc_id", text_col: str = "text", many_words: int = MANY_WORDS) -> DataFrame:
    """doc, start and n of each stretch of lines that repeats an earlier one."""
    met = written(extended(written(fingerprints(docs, min_lines, id_col, text_col, many_words), "fingerprints"), min_lines), "extended")
    later = met.where("left IS NOT NULL").select("doc", (F.col("pos") - F.col("left")).alias("start"), (F.col("left") + F.col("right") + 1).alias("n"))
    left, right = F.floor(F.col("x") / min_lines).cast("int"), F.col("x") % min_lines
    rest = met.select("id", "doc", "pos", "around", F.explode("rest").alias("x"))
    rest = rest.select(F.struct("id", "doc", (F.col("pos") - left).alias("start")).alias("at"), (left + right + 1).alias("n"), F.unhex(F.md5(F.substring("around", 16 * (min_lines - 1 - left) + 1, 16 * (left + right + 1)))).alias("win"))
    first = rest.groupBy("win").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").select("win", "first")
    return later.unionByName(rest.join(written(first, "first").hint("merge"), "win").where("at <> first").select("at.doc", "at.start", "n"))


def drop_repeated_runs(docs: DataFrame, min_lines: int = 3, id_col: str = "doc_id", text_col: str = "text", many_words: int = MANY_WORDS) -> DataFrame:
    """`row` (the input's columns), `kept` (the text that is left), `n_lines`, `runs` (array of first line and line behind)."""
    if min_lines < 2:
        raise ValueError("a run has at least two lines, or many words")
    windows = repeated_runs(docs, min_lines, id_col, text_col, many_words).groupBy("doc").agg(F.collect_set(F.struct("start", "n")).alias("s"))
    gone = windows.select("doc", F.expr("array_sort(array_distinct(flatten(transform(s, x -> sequence(x.start, x.start + x.n - 1)))))").alias("s"))
    # the text goes with its row, and not a second time beside it
    d = keyed(docs, id_col, text_col, keep=True).select("doc", "row").join(gone, "doc", "left")
    d = d.withColumn("text", F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))).withColumn("lines", F.split("text", "\n", -1))
    # A deleted line opens a run unless the one before is deleted, and closes one unless the next is.
    pairs = "zip_with(s, {}, (x, y) -> struct(x, y))"
    before, after = pairs.format("concat(array(-2), slice(s, 1, size(s) - 1))"), pairs.format("concat(slice(s, 2, size(s) - 1), array(2147483647))")
    opens = f"transform(filter({before}, p -> p.x > p.y + 1), p -> p.x)"
    ends = f"transform(filter({after}, p -> p.y - 1 > p.x), p -> p.x + 1)"
    d = d.withColumn("opens", F.when(F.col("s").isNull(), F.expr("array()").cast("array<int>")).otherwise(F.expr(opens)))
    d = d.withColumn("ends", F.when(F.col("s").isNull(), F.expr("array()").cast("array<int>")).otherwise(F.expr(ends)))
    left = "flatten(zip_with(concat(array(0), ends), concat(opens, array(size(lines))), (a, b) -> slice(lines, a + 1, b - a)))"
    return d.select("row", F.expr(f"CASE WHEN s IS NULL THEN text ELSE array_join({left}, '\n') END").alias("kept"), F.size("lines").alias("n_lines"), F.expr("zip_with(opens, ends, (a, b) -> struct(a AS start, b AS stop))").alias("runs"))


def without_repeated_runs(docs: DataFrame, min_lines: int = 3, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", many_words: int = MANY_WORDS) -> DataFrame:
    """`docs` with later runs deleted from the text and its length renewed; rows of which nothing is left go."""
    d = drop_repeated_runs(docs, min_lines, id_col, text_col, many_words).where("size(runs) = 0 OR kept <> ''")
    new = {text_col: F.when(F.size("runs") > 0, F.col("kept")).otherwise(F.col(f"row.{text_col}"))}
    if length_col in docs.columns:
        new[length_col] = F.when(F.size("runs") > 0, F.length("kept").cast(docs.schema[length_col].dataType)).otherwise(F.col(f"row.{length_col}"))
    return d.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def dedup_report(docs: DataFrame, min_lines: int = 3) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed (lines), n_runs, kept_chars, kept_sha256."""
    removed = F.aggregate("runs", F.lit(0), lambda n, r: n + r["stop"] - r["start"])
    return drop_repeated_runs(docs, min_lines).select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), F.size("runs").cast("long").alias("n_runs"), F.length("kept").cast("long").alias("kept_chars"), F.sha2("kept", 256).alias("kept_sha256"))


def oracle(min_lines: int = 3, many_words: int = MANY_WORDS) -> str:
    """The whole rule, over all runs of up to min_lines lines: longer ones are chains of them."""
    m = min_lines
    return f"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
a AS (SELECT doc_id, text, l, s, unnest(range(1, least({m}, len(l) - s) + 1)) AS n FROM (SELECT *, unnest(range(len(l))) AS s FROM d)),
w AS (SELECT *, array_to_string(l[s + 1 : s + n], chr(10)) AS win FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY win, n ORDER BY doc_id NULLS FIRST, md5(coalesce('=' || doc_id, '-') || chr(0) || text), s) AS k FROM w
      WHERE n = {m} OR len(regexp_extract_all(win, '[^ \\t\\r\\n\\f\\x0B]+')) > {many_words}),
gone AS (SELECT doc_id, text, list(DISTINCT j) AS j FROM (SELECT doc_id, text, unnest(range(s, s + n)) AS j FROM r WHERE k > 1) GROUP BY ALL),
e AS (SELECT d.doc_id, d.text, d.l, coalesce(gone.j, []) AS j FROM d LEFT JOIN gone ON d.doc_id IS NOT DISTINCT FROM gone.doc_id AND d.text = gone.text),
k AS (SELECT doc_id, text, l, j, CASE WHEN len(j) = 0 THEN text ELSE array_to_string(list_transform(list_filter(range(len(l)), lambda x: NOT list_contains(j, x)), lambda x: l[x + 1]), chr(10)) END AS kept FROM e)
SELECT a.doc_id, len(k.l) AS n_lines, len(k.j) AS n_removed, len(list_filter(k.j, lambda x: NOT list_contains(k.j, x - 1))) AS n_runs,
       length(k.kept) AS kept_chars, sha256(k.kept) AS kept_sha256
FROM documents a JOIN k ON a.doc_id IS NOT DISTINCT FROM k.doc_id AND coalesce(a.text, '') = k.text"""
