"""Cutting Markdown texts into chunks: by headings, by size, and by both."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACE, chunk_id, stripped

#: Shorter chunks, stripped, are dropped.
LEAST_CHARS = 50
HEADING = rf"^(#{{1,3}}){SPACE}+(.+)$"


def _sections(docs: DataFrame, source: str, text: str, skip_fences: bool = False) -> DataFrame:
    """source and sections, an array of struct(level, heading, heading_path, line_start, line_end, body).

    The lines of a document are folded once, in its own row, with the open headings of three levels as state.
    """
    d = docs.select(F.col(source).alias("source"), F.split(F.col(text), "\n", -1).alias("lines")).where("lines IS NOT NULL")
    mark = r"CASE WHEN x RLIKE '^#{1,3}[ \\t\\n\\x0B\\f\\r]+.' THEN length(regexp_extract(x, '^(#{1,3})', 1)) ELSE 0 END"
    levels = F.expr(f"transform(lines, x -> {mark})")
    if skip_fences:
        state = "named_struct('f', {}, 'open', {})"
        begin = state.format("CAST(array() AS array<boolean>)", "false")
        step = state.format("concat(a.f, array(a.open OR x LIKE '```%'))", "a.open <> (x LIKE '```%')")
        fenced = f"aggregate(lines, {begin}, (a, x) -> {step}, a -> a.f)"
        levels = F.expr(f"zip_with(transform(lines, x -> {mark}), {fenced}, (l, f) -> CASE WHEN f THEN 0 ELSE l END)")
    d = d.select("source", "lines", levels.alias("levels"))
    heads = "filter(transform(levels, (l, i) -> named_struct('at', i, 'level', l, 'title', CASE WHEN l > 0 THEN trim(substr(lines[i], l + 1)) END)), h -> h.level > 0)"
    d = d.select("source", "lines", F.expr(heads).alias("heads"))
    opening = "CASE WHEN size(heads) = 0 OR heads[0].at > 0 THEN concat(array(named_struct('at', 0, 'level', 0, 'title', CAST(NULL AS string))), heads) ELSE heads END"
    d = d.select("source", "lines", F.expr(opening).alias("heads"))
    none = F.lit(None).cast("string")
    begin = F.struct(none.alias("one"), none.alias("two"), none.alias("three"), F.array().cast("array<string>").alias("paths"))

    def step(a: Column, h: Column) -> Column:
        one = F.when(h["level"] == 1, h["title"]).otherwise(a["one"])
        two = F.when(h["level"] == 2, h["title"]).when(h["level"] == 1, none).otherwise(a["two"])
        three = F.when(h["level"] == 3, h["title"]).when(h["level"].isin(1, 2), none).otherwise(a["three"])
        return F.struct(one.alias("one"), two.alias("two"), three.alias("three"), F.concat(a["paths"], F.array(F.concat_ws(" > ", one, two, three))).alias("paths"))

    # rows of one element: what the fold gives is made once, and not again for each section that reads it
    d = d.select("source", F.inline(F.array(F.struct("lines", "heads", F.aggregate("heads", begin, step, lambda a: a["paths"]).alias("paths")))))

    def section(h: Column, i: Column) -> Column:
        stop = F.coalesce(F.get("heads", i + 1)["at"], F.size("lines"))
        body = stripped(F.array_join(F.slice("lines", h["at"] + 1, stop - h["at"]), "\n"))
        heading = F.when(h["level"] > 0, h["title"]).otherwise(F.lit("intro"))
        return F.struct(h["level"].alias("level"), heading.alias("heading"), F.get("paths", i).alias("heading_path"), (h["at"] + 1).alias("line_start"), stop.alias("line_end"), body.alias("body"))

    return d.select("source", F.transform("heads", section).alias("sections"))


def sections(docs: DataFrame, source: str, text: str, skip_fences: bool = False) -> DataFrame:
    """source, ord, level, heading, heading_path, line_start, line_end (from 1), body: one row a section.

    A heading of up to three signs opens a section; what precedes the first one is `intro`. The path is the chain of
    open headings, each deeper than the last. With skip_fences, signs within fenced code are no headings. Nothing is
    shuffled.
    """
    return _sections(docs, source, text, skip_fences).select("source", F.posexplode("sections").alias("ord", "s")).select("source", "ord", "s.*")


def heading_chunks(docs: DataFrame, source: str, text: str) -> DataFrame:
    """chunk_id, source, ord (among the chunks that stay), heading, heading_path, text, char_count, line_start, line_end."""
    kept = F.filter("sections", lambda s: F.length(s["body"]) > LEAST_CHARS)
    s = _sections(docs, source, text).select("source", F.posexplode(kept).alias("ord", "s")).select("source", "ord", "s.*")
    shown = F.when(F.col("heading_path") != "", F.concat(F.lit("["), "heading_path", F.lit("]\n\n"), "body")).otherwise(F.col("body"))
    return s.select(chunk_id(F.col("source"), shown).alias("chunk_id"), "source", "ord", "heading", "heading_path", shown.alias("text"), F.length(shown).alias("char_count"), "line_start", "line_end")


def first_chunks(docs: DataFrame, source: str, text: str) -> DataFrame:
    """heading_chunks, of equal ids the one that begins first: of a source with one row, as nearly all have, within its own row, so that no text is moved."""
    kept = F.filter("sections", lambda s: F.length(s["body"]) > LEAST_CHARS)
    s = _sections(docs, source, text).select("source", kept.alias("kept"))
    said = lambda s: F.when(s["heading_path"] != "", F.concat(F.lit("["), s["heading_path"], F.lit("]\n\n"), s["body"])).otherwise(s["body"])
    # rows of one element: each step reads what the one before made, and doesn't make it anew
    s = s.select("source", "kept", F.inline(F.array(F.struct(F.transform("kept", said).alias("shown")))))
    s = s.select("source", "kept", "shown", F.inline(F.array(F.struct(F.transform("shown", lambda x: chunk_id(F.col("source"), x)).alias("ids")))))
    order = F.array_sort(F.transform("ids", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    s = s.select("source", "kept", "shown", "ids", F.inline(F.array(F.struct(order.alias("o")))))
    firsts = F.expr("transform(filter(o, (y, j) -> j = 0 OR y.x <> o[j - 1].x), y -> y.i)")
    s = s.select("source", "kept", "shown", "ids", F.explode(firsts).alias("ord"))
    at = lambda c: F.col(c)[F.col("ord")]
    k = at("kept")
    s = s.select(at("ids").alias("chunk_id"), "source", "ord", k["heading"].alias("heading"), k["heading_path"].alias("heading_path"), at("shown").alias("text"), k["line_start"].alias("line_start"), k["line_end"].alias("line_end"))
    c = s.select("chunk_id", "source", "ord", "heading", "heading_path", "text", F.length("text").alias("char_count"), "line_start", "line_end")
    several = docs.where(F.col(text).isNotNull()).groupBy(F.col(source).alias("source")).count().where("count > 1").select("source")
    if not several.take(1):
        return c
    first = F.min_by(F.struct(*c.columns), F.struct("line_start", "ord"))
    again = c.join(several, "source", "left_semi").groupBy("chunk_id").agg(first.alias("c")).select("c.*")
    return c.join(several, "source", "left_anti").unionByName(again)


def cuts(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """First and last places of pieces of `most` characters that overlap; a piece ends behind its last full stop if that is past its middle.

    Pieces begin until the text ends, so the last one may lie within the one before.
    """
    out, start = [], 0
    while start < len(text):
        stop = start + most
        if stop < len(text):
            dot = text.rfind(". ", start, stop)
            if dot - start > most * 0.5:
                stop = dot + 1
        out.append((start, min(stop, len(text))))
        start = stop - overlap
    return out


def fixed_chunks(docs: DataFrame, source: str, text: str, most: int = 2000, overlap: int = 200) -> DataFrame:
    """chunk_id, source, ord, heading (`chunk-n`), start, stop, text, char_count, line_start, line_end: pieces of a bounded size.

    A source is one row. The next cut depends on the last, so a Python loop makes them. Pieces are stripped, and those
    of up to LEAST_CHARS characters go.
    """
    if overlap * 2 >= most:
        raise ValueError("pieces must get on by more than half their size")
    kind = docs.schema[source].dataType.simpleString()
    names = ["source", "ord", "start", "stop", "text", "line_start", "line_end"]

    def pieces(s, t: str) -> Iterator[tuple]:
        n = 0
        for a, b in cuts(t, most, overlap):
            if len(said := t[a:b].strip()) > LEAST_CHARS:
                first = t.count("\n", 0, a) + 1
                yield s, n, a, b, said, first, first + t.count("\n", a, b)
                n += 1

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([x for s, t in zip(f["source"], f["text"], strict=True) for x in pieces(s, t)], columns=names)

    d = docs.where(F.col(text).isNotNull()).select(F.col(source).alias("source"), F.col(text).alias("text"))
    cut = d.mapInPandas(work, f"source {kind}, ord int, start int, stop int, text string, line_start int, line_end int")
    return cut.select(chunk_id(F.col("source").cast("string"), F.col("text")).alias("chunk_id"), "source", "ord", F.concat(F.lit("chunk-"), F.col("ord").cast("string")).alias("heading"), "start", "stop", "text", F.length("text").alias("char_count"), "line_start", "line_end")


def hybrid_chunks(docs: DataFrame, source: str, text: str, most: int = 2000, overlap: int = 200) -> DataFrame:
    """Heading chunks, long ones cut further: chunk_id, source, ord, part (0: whole), heading, heading_path, text, char_count, line_start, line_end.

    A part keeps the path of its section, and its lines are counted in the document: the line of the path that a chunk's
    text begins with, and the empty one behind it, count as the section's first.
    """
    h = heading_chunks(docs, source, text)
    cols = ["source", "ord", "part", "heading", "heading_path", "text", "char_count", "line_start", "line_end"]
    long = h.where(F.length("text") > most).withColumn("key", F.concat_ws("\x01", F.col("source"), F.col("ord").cast("string")))
    parts = fixed_chunks(long, "key", "text", most, overlap).select(F.col("source").alias("key"), (F.col("ord") + 1).alias("part"), "text", "char_count", F.col("line_start").alias("a"), F.col("line_end").alias("b"))
    ahead = F.when(F.col("heading_path") != "", 2).otherwise(0)
    line = lambda c: F.greatest(F.col("line_start") + F.col(c) - 1 - ahead, F.col("line_start"))
    cut = parts.join(long.select("key", "source", "ord", "heading", "heading_path", "line_start"), "key")
    cut = cut.select("source", "ord", "part", F.concat("heading", F.lit(" (part "), F.col("part").cast("string"), F.lit(")")).alias("heading"), "heading_path", "text", "char_count", line("a").alias("line_start"), line("b").alias("line_end"))
    out = h.where(F.length("text") <= most).withColumn("part", F.lit(0)).select(cols).unionByName(cut.select(cols))
    return out.select(chunk_id(F.col("source").cast("string"), F.col("text")).alias("chunk_id"), *cols)
