"""Benchmark decontamination: a positional inverted index over the corpus, read from the rarest test terms.

Words are runs of digits, A-Z (lower-cased), a-z and all code points from U+0080 on. An item's windows are its runs
of `width` consecutive words; an item of fewer words, but not none, is one window.

1. Occurrences of the benchmark's terms are counted over the whole corpus. A window with a term that the corpus
   lacks cannot occur and ends here.
2. The index stores a posting (term, document, position) for every occurrence of a term that is the rarest or second
   rarest of some window. Those of rarest terms carry the `width` - 1 words on either side.
3. Each window reads its rarest term's postings; position less offset is where the window may start. Of these places
   those stay at which the second list, adjusted by its own offset, has a posting too: an equi-join on (document,
   term, position), whose keys are all different, so that no word is hot in it. There every other word is compared.
4. `proximity_matches` asks for the two rarest terms within a distance instead, in either order.

Postings are made where a document is read, and only places and matches are moved. Terms and windows are broadcast
only if their measured bytes are within a bound, and joined by shuffle otherwise: then words are counted before
anything is joined, places of the terms are found first, and texts are moved once to give these their neighbourhoods.

Nulls: a null text has no words; an item's null id counts as an item whose id is the empty string. Items are told
apart by id. Rows that repeat id and text share one result. Without documents or items, no window occurs. Terms that
are equally rare are ordered by their letters, then by their place in the window. Very long texts are read whole; a
document's words are one array in its task. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import doc_key, sized, small_side, written

#: What separates words, letters of either case being part of them.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: NEAR: words between two terms that stand near each other, one of them counted.
WIDTH, NEAR = 13, 5


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP, -1), "")


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, ascii_uppercase, ascii_lowercase))


def item_windows(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, win (its words, joined by spaces), len: once for each window of an item."""
    item = F.coalesce(items[id_col].cast("string"), F.lit(""))
    w = items.select(item.alias("item"), raw_words(F.translate(F.coalesce(items[text_col], F.lit("")), ascii_uppercase, ascii_lowercase)).alias("w")).where("size(w) > 0")
    w = w.withColumn("len", F.least(F.size("w"), F.lit(width))).withColumn("last", F.size("w") - F.col("len"))
    shifted = F.arrays_zip(*[F.slice("w", F.lit(i + 1), F.col("last") + 1).alias(f"w{i}") for i in range(width)])
    rows = w.select("item", "len", F.inline(shifted))
    # shorter items leave the later places empty, and concat_ws skips nulls
    return rows.select("item", F.concat_ws(" ", *[F.when(F.col("len") > i, F.col(f"w{i}")) for i in range(width)]).alias("win"), "len").distinct()


def term_counts(docs: DataFrame, windows: DataFrame, text_col: str = "text") -> DataFrame:
    """term, n: occurrences in the corpus of every term of the windows that has any."""
    terms, small = sized(windows.select(F.explode(F.split("win", " ")).alias("term")).distinct(), F.octet_length("term") + 16)
    said = docs.select(F.explode(raw_words(docs[text_col])).alias("term")).select(lower_ascii(F.col("term")).alias("term"))
    counted = lambda x: x.groupBy("term").agg(F.count("*").alias("n"))
    # counted where they are read, before anything is joined: a very common word is one row of each task
    return counted(said.join(F.broadcast(terms), "term")) if small else counted(said).join(terms, "term")


def rare_windows(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """win, len, term and at (the rarest and its offset), term2 and at2 (the next; null where there is one word)."""
    one = windows.select("win", "len").distinct()
    at = one.select("win", "len", F.posexplode(F.split("win", " ")).alias("at", "term")).join(small_side(counts, F.octet_length("term") + 24), "term", "left")
    by = at.groupBy("win", "len").agg(F.count("n").alias("known"), F.sort_array(F.collect_list(F.struct("n", "term", "at"))).alias("t")).where("known = len")
    return by.select("win", "len", F.col("t")[0]["term"].alias("term"), F.col("t")[0]["at"].alias("at"), F.get("t", F.lit(1))["term"].alias("term2"), F.get("t", F.lit(1))["at"].alias("at2"))


def anchors(windows: DataFrame) -> DataFrame:
    """term, first: the terms that are rarest or second rarest of a window, and whether it is the rarest of any."""
    two = windows.select("term", F.lit(True).alias("first")).union(windows.where("term2 IS NOT NULL").select("term2", F.lit(False)))
    return two.groupBy("term").agg(F.max("first").alias("first"))


def build_index(docs: DataFrame, terms: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, doc, pos, near: the postings of terms (term, first), with 2 * width - 1 words, as far as there are so many, around those of first ones."""
    reach = width - 1
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(doc_key(docs[id_col], text).alias("doc"), raw_words(text).alias("w"))
    rows = rows.select("doc", "w", F.posexplode("w").alias("pos", "word")).withColumn("term", lower_ascii(F.col("word")))
    around = lower_ascii(F.array_join(F.slice("w", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(reach)) + width), " "))
    look, small = sized(terms, F.octet_length("term") + 16)
    if small:
        # one fused loop over the words: only a posting reads its neighbourhood
        return rows.join(F.broadcast(look), "term").select("term", "doc", "pos", F.when(F.col("first"), around).alias("near"))
    # both sides of the first join are not aggregates, so that Spark splits it at a common term; only the places that
    # are left go back to their texts, which are moved once
    places = written(rows.select("term", "doc", "pos").join(written(look, "anchors").hint("merge"), "term"), "places")
    wanted = places.where("first").groupBy("doc").agg(F.collect_set(F.struct("pos", "term")).alias("places"))
    texts = docs.select(doc_key(docs[id_col], text).alias("doc"), text.alias("text")).dropDuplicates(["doc"])
    first = texts.join(wanted, "doc").select("doc", raw_words(F.col("text")).alias("w"), F.explode("places").alias("x")).select("doc", "w", "x.pos", "x.term")
    return places.where("NOT first").select("term", "doc", "pos", F.lit(None).cast("string").alias("near")).unionByName(first.select("term", "doc", "pos", around.alias("near")))


def intersected(index: DataFrame, windows: DataFrame) -> DataFrame:
    """doc, start, len, win, offset, near: places at which both of a window's two rarest terms stand where the window has them."""
    width = F.octet_length("win") + F.octet_length("term") + F.coalesce(F.octet_length("term2"), F.lit(0)) + 40
    places = index.join(small_side(windows, width), "term").withColumn("start", F.col("pos") - F.col("at")).where("start >= 0").withColumn("pos2", F.col("start") + F.col("at2"))
    two = index.select("doc", F.col("term").alias("term2"), F.col("pos").alias("pos2"))
    both = places.where("term2 IS NOT NULL").join(two, ["doc", "term2", "pos2"], "left_semi").unionByName(places.where("term2 IS NULL"))
    return both.select("doc", "start", "len", "win", (F.col("pos") - F.col("start")).alias("offset"), "pos", "near")


def phrase_matches(index: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """doc, start, len, win of every exact occurrence: the places left, with all their words compared."""
    first = F.greatest(F.least(F.col("pos"), F.lit(width - 1)) - F.col("offset"), F.lit(0))  # conditions may be read in any order
    said = F.array_join(F.slice(F.split("near", " "), first + 1, F.col("len")), " ")
    return intersected(index, windows).where(said == F.col("win")).select("doc", "start", "len", "win")


def proximity_matches(index: DataFrame, windows: DataFrame, width: int, near: int = NEAR) -> DataFrame:
    """doc, term, term2 of every window's two rarest terms that stand within `near` (below width) words of each other somewhere, in either order."""
    if near >= width:
        raise ValueError("a posting's neighbourhood does not reach so far")
    pairs = windows.where("term2 IS NOT NULL").select("term", "term2").distinct()
    hit = index.where("near IS NOT NULL").join(small_side(pairs, F.octet_length("term") + F.octet_length("term2") + 32), "term")
    words, own = F.split("near", " "), F.least(F.col("pos"), F.lit(width - 1))
    before = F.slice(words, F.greatest(own - near, F.lit(0)) + 1, F.least(own, F.lit(near)))
    after = F.slice(words, own + 2, F.lit(near))
    return hit.where(F.array_contains(before, F.col("term2")) | F.array_contains(after, F.col("term2"))).select("doc", "term", "term2").distinct()


def indexed(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The items' windows, those that may occur with their rarest terms, and the index of these, each as written."""
    windows = written(item_windows(items, width), "windows")
    rare = written(rare_windows(windows, written(term_counts(docs, windows), "counts")), "rare")
    return windows, rare, written(build_index(docs, anchors(rare), width, id_col), "postings")


def covered(found: DataFrame) -> DataFrame:
    """doc, n_hit: how many words of each document the matches cover."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], x["stop"]).alias("reach"))
    spans = found.select("doc", "start", (F.col("start") + F.col("len")).alias("stop")).distinct()
    return spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("s")).select("doc", F.aggregate("s", empty, step)["n"].alias("n_hit"))


def contamination_report(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items of which a window is near)."""
    windows, rare, index = indexed(docs, items, width)
    found = written(phrase_matches(index, rare, width).distinct(), "matches")
    bytes_of = F.octet_length("win") + F.octet_length("item") + 32
    of = found.select("doc", "win").distinct().join(small_side(windows.select("win", "item"), bytes_of), "win").select("doc", "item").distinct()
    item_pairs = rare.join(small_side(windows.select("win", "item"), bytes_of), "win").select("term", "term2", "item").distinct()
    near = proximity_matches(index, rare, width, min(NEAR, width - 1)).join(small_side(item_pairs, F.lit(64) + F.octet_length("item")), ["term", "term2"]).select("doc", "item").distinct()
    by = of.groupBy("doc").agg(F.sort_array(F.collect_list("item")).alias("items"))
    text = F.coalesce(docs["text"], F.lit(""))
    d = docs.select(docs["doc_id"], doc_key(docs["doc_id"], text).alias("doc"), F.size(raw_words(text)).cast("long").alias("n_words"))
    d = d.join(covered(found), "doc", "left").join(by, "doc", "left").join(near.groupBy("doc").agg(F.count("*").alias("n_near")), "doc", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return d.select("doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), ((hit > 0) & (hit * 20 >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def clean_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of documents that are not contaminated, as they are: at least a twentieth of the words is hit in those that go."""
    _, rare, index = indexed(docs, items, width)
    n = written(covered(phrase_matches(index, rare, width)), "covered")
    text = F.coalesce(docs["text"], F.lit(""))
    d = docs.select(doc_key(docs["doc_id"], text).alias("doc"), F.struct(*[docs[c] for c in docs.columns]).alias("row")).join(small_side(n, F.lit(40)), "doc", "left")
    return d.where(F.col("n_hit").isNull() | (F.col("n_hit") * 20 < F.size(raw_words(F.coalesce(F.col("row")["text"], F.lit("")))))).select("row.*")


def oracle(width: int = WIDTH, near: int = NEAR) -> str:
    words = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS w FROM benchmark),
x AS (SELECT DISTINCT item, least(len(w), {width}) AS n, array_to_string(w[s + 1 : s + least(len(w), {width})], ' ') AS win
      FROM (SELECT *, unnest(range(greatest(len(w) - {width - 1}, 1))) AS s FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS win FROM (SELECT d.*, n, unnest(range(greatest(len(w) - n + 1, 0))) AS s FROM d, (SELECT DISTINCT n FROM x))),
h AS (SELECT doc_id, s, g.n, item FROM g JOIN x USING (win, n)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS j FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id),
t AS (SELECT * FROM (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d) WHERE term IN (SELECT unnest(w) FROM b)),
f AS (SELECT term, count(*) AS n FROM t GROUP BY term),
y AS (SELECT win, unnest(string_split(win, ' ')) AS term, unnest(range(n)) AS place, n AS size FROM (SELECT DISTINCT win, n FROM x)),
r AS (SELECT win, list(term ORDER BY f.n, term, place) AS rare FROM y JOIN f USING (term) GROUP BY win, size HAVING count(*) = size AND size > 1),
p AS (SELECT DISTINCT item, rare[1] AS one, rare[2] AS two FROM r JOIN x USING (win)),
q AS (SELECT DISTINCT o.doc_id, o.term AS one, u.term AS two FROM t o JOIN (SELECT DISTINCT one, two FROM p) k ON o.term = k.one JOIN t u ON u.doc_id = o.doc_id AND u.term = k.two AND abs(o.pos - u.pos) BETWEEN 1 AND {near}),
z AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM q JOIN p USING (one, two) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN z USING (doc_id)"""
