"""Secret scans: candidates by pattern, then by who owns them across the corpus.

Base spans come from three patterns (assign, access, hex). The method adds to them: every candidate value, the base
ones and long runs that mix letters and digits, is counted over the whole corpus by distinct repositories and
distinct owners. A value that many owners hold is a copied example; a value of few owners looks live. Mixed runs
that look live and touch no base span become spans of kind `owned`.

Positions need no Python: a regular expression's matches and the pieces between them alternate, so a running sum of
lengths gives each match its place. Candidates are found in one pass over the texts and written once; values go on as
128-bit hashes, so that no secret and no text is shuffled or written.

Nulls: a null text has no spans; a null repository or owner is one value of its own. Rows that repeat id and text
are scanned as one and share the result. Empty tables give no rows. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import doc_key, written


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


WORDS = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = "(" + "|".join(map(_any_case, WORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: pattern and the group that holds the value. Equal starts are ordered as listed.
PATTERNS = {"assign": (ASSIGN, 2), "access": ("AKIA[A-Z0-9]{16,}", 0), "hex": ("[0-9a-f]{24,}", 0), "owned": ("[A-Za-z0-9+/_-]{20,}", 0)}
#: From this many distinct owners or repositories on, a value is a copied example.
SHARED_OWNERS, SHARED_REPOSITORIES = 3, 20


def candidates(docs: DataFrame, repo: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, rank (of the kind), start, end, key (128-bit hash of the value), repo, owner of every candidate."""
    text = F.coalesce(docs[text_col], F.lit(""))
    d = docs.select(doc_key(docs[id_col], text).alias("doc"), repo.alias("repo"), owner.alias("owner"), text.alias("text"))
    # one pass over the texts for all kinds; the pieces between matches are cut out only where there are some
    d = d.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"whole{i}") for i, (p, _) in enumerate(PATTERNS.values())])
    d = d.where(" OR ".join(f"size(whole{i}) > 0" for i in range(len(PATTERNS))))

    def kind(rank: int, pattern: str, group: int) -> Column:
        whole = F.col(f"whole{rank}")
        value = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else whole
        gaps = F.slice(F.split("text", F.lit(pattern), -1), F.lit(1), F.size(whole))
        return F.when(F.size(whole) > 0, F.struct(F.lit(rank).alias("rank"), F.arrays_zip(whole.alias("whole"), value.alias("value"), gaps.alias("gap")).alias("found")))

    rows = d.select("doc", "repo", "owner", F.explode(F.filter(F.array(*[kind(i, *x) for i, x in enumerate(PATTERNS.values())]), lambda x: x.isNotNull())).alias("k"))
    rows = rows.select("doc", "repo", "owner", "k.rank", F.posexplode("k.found").alias("i", "m"))
    value = F.col("m")["value"]
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    fine = F.when(F.col("rank") == 0, F.length(value) >= 6).when(F.col("rank") == 3, mixed).otherwise(True)
    rows = rows.select("doc", "repo", "owner", "rank", "i", F.unhex(F.md5(value)).alias("key"), fine.alias("fine"), F.length("m.whole").alias("n"), F.length("m.gap").alias("gap")).distinct()  # repeated rows hold each match again
    upto = Window.partitionBy("doc", "repo", "owner", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("n") + F.col("gap")).over(upto)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("n")).where("fine").select("doc", "rank", "start", "end", "key", "repo", "owner")


def ownership(found: DataFrame) -> DataFrame:
    """key, n_repos and n_owners over the corpus, shared (a copied example)."""
    # distinct rows and not distinct counts: a null is one more repository or owner
    by_repo = found.select("key", "repo").distinct().groupBy("key").agg(F.count("*").alias("n_repos"))
    by_owner = found.select("key", "owner").distinct().groupBy("key").agg(F.count("*").alias("n_owners"))
    return by_repo.join(by_owner, "key").withColumn("shared", (F.col("n_owners") >= SHARED_OWNERS) | (F.col("n_repos") >= SHARED_REPOSITORIES))


def secret_spans(docs: DataFrame, repo: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, kind, start, end, key, n_repos, n_owners, shared of each span, base ones and added ones."""
    found = written(candidates(docs, repo, owner, id_col, text_col), "candidates")
    base = F.col("rank") < 3
    order = Window.partitionBy("doc").orderBy("start", "rank")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    spans = found.groupBy("doc", "rank", "start", "end").agg(F.min("key").alias("key"))  # rows of one document
    spans = spans.withColumn("before", before).withColumn("after", after).where(base | ((F.coalesce("before", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True))))
    # written, so that the join is split at a value of very many documents, which a copied example is
    owned = written(ownership(found), "ownership").hint("merge")
    spans = spans.select("doc", "rank", "start", "end", "key").join(owned, "key", "left").where(base | ~F.col("shared"))
    return spans.withColumn("kind", F.element_at(F.array(*map(F.lit, PATTERNS)), F.col("rank") + 1))


def secret_report(docs: DataFrame, repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_shared.

    By default each document is a repository and its source is the owner.
    """
    spans = secret_spans(docs, docs["doc_id"] if repo is None else repo, docs["source"] if owner is None else owner)
    of = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in PATTERNS]
    said = F.array_sort(F.collect_list(F.struct("start", "rank", F.concat_ws(":", "kind", "start", "end").alias("span"))))
    by = spans.groupBy("doc").agg(*of, said.alias("said"), F.count_if(~F.col("shared")).alias("n_live"), F.count_if("shared").alias("n_shared"))
    text = F.coalesce(docs["text"], F.lit(""))
    out = docs.select(docs["doc_id"], doc_key(docs["doc_id"], text).alias("doc")).join(by, "doc", "left")
    base = F.array_join(F.expr("transform(filter(said, x -> x.rank < 3), x -> x.span)"), ",")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(F.coalesce(base, F.lit("")), 256).alias("base_sha256"), F.coalesce(F.array_join(F.expr("transform(said, x -> x.span)"), ","), F.lit("")).alias("spans"), zero("n_owned"), zero("n_live"), zero("n_shared"))


def oracle() -> str:
    def of(rank: int, pattern: str, group: int) -> str:
        p = "'" + pattern.replace("'", "''") + "'"
        return f"SELECT doc_id, source, t, {rank} AS rank, regexp_extract_all(t, {p}) AS whole, regexp_extract_all(t, {p}, {group}) AS vals, string_split_regex(t, {p}) AS gaps FROM d"

    found = " UNION ALL ".join(of(rank, *x) for rank, x in enumerate(PATTERNS.values()))
    return f"""
WITH d AS (SELECT DISTINCT doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({found}),
m AS (SELECT doc_id, source, t, rank, unnest(range(1, len(whole) + 1)) AS i, whole, vals, gaps FROM f),
p AS (SELECT doc_id, source, t, rank, vals[i] AS value, length(whole[i]) AS n, sum(length(gaps[i]) + length(whole[i])) OVER (PARTITION BY doc_id, source, t, rank ORDER BY i) AS e FROM m),
c AS (SELECT doc_id, source, t, rank, value, (e - n)::BIGINT AS s, e::BIGINT AS e FROM p
      WHERE CASE rank WHEN 0 THEN length(value) >= 6 WHEN 3 THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') ELSE true END),
o AS (SELECT value, count(DISTINCT coalesce('=' || source, '-')) >= {SHARED_OWNERS} OR count(DISTINCT coalesce('=' || doc_id, '-')) >= {SHARED_REPOSITORIES} AS shared FROM c GROUP BY value),
u AS (SELECT DISTINCT doc_id, t, rank, value, s, e FROM c),
a AS (SELECT u.*, o.shared, ['assign', 'access', 'hex', 'owned'][rank + 1] AS kind FROM u JOIN o USING (value)
      WHERE rank < 3 OR NOT shared AND NOT EXISTS (SELECT 1 FROM u b WHERE b.doc_id IS NOT DISTINCT FROM u.doc_id AND b.t = u.t AND b.rank < 3 AND b.s < u.e AND u.s < b.e)),
g AS (SELECT doc_id, t, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, count(*) FILTER (rank = 3) AS n_owned,
             count(*) FILTER (NOT shared) AS n_live, count(*) FILTER (shared) AS n_shared,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM a GROUP BY doc_id, t)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared
FROM documents d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND coalesce(d.text, '') = g.t"""
