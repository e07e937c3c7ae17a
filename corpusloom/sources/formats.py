"""Readers: files of several formats become Markdown text. Text formats are column expressions; the rest is parsed by small helpers in Arrow batches."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ["md", "txt", "pdf", "html", "htm", "rst", "docx", "json", "yaml", "yml", "csv"]


def discover(spark: SparkSession, root: str, metadata: str = ".corpusloom") -> DataFrame:
    """path, content, length and modificationTime of the supported files under root, without folders that begin with `metadata`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith(metadata))
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(EXTENSIONS) & ~hidden)


def outside(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files without those below any of roots (root), such as nested repositories: each path's folders are looked up."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    bad = files.select("path", F.explode(above).alias("root")).join(roots.select("root").distinct(), "root", "left_semi").select("path").distinct()
    return files.join(bad, "path", "left_anti")


def titled(name: Column, body: Column) -> Column:
    return F.concat(F.lit("# "), name, F.lit("\n\n"), body)


def fenced(body: Column, kind: str) -> Column:
    return F.concat(F.lit(f"```{kind}\n"), body, F.lit("\n```"))


class _Html(HTMLParser):
    """The blocks of a page in the order in which they open: headings, list items, paragraphs, code and table rows.

    A block holds all text within it, also that of blocks inside; such blocks come again by themselves. Text outside of
    blocks is left out, and so are scripts, styles and page furniture with all that they hold.
    """

    DROPPED = ("script", "style", "nav", "footer", "header")
    BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "tr", "code")
    VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str]]] = []  # a tag and the pieces of text in it
        self.out: list[tuple[str, str, list[str], list[list[str]]]] = []  # tag, the tag around it, pieces, cells' pieces

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.VOID:
            return
        pieces: list[str] = []
        dropped = tag in self.DROPPED or any(t in self.DROPPED for t, _ in self.open)
        if not dropped and tag in self.BLOCKS:
            self.out.append((tag, self.open[-1][0] if self.open else "", pieces, []))
        if not dropped and tag in ("td", "th"):
            for t, _, of, cells in self.out:
                if t == "tr" and any(of is held for _, held in self.open):
                    cells.append(pieces)
        self.open.append((tag, pieces))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):  # what is open inside ends, too
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not any(t in self.DROPPED for t, _ in self.open):
            for _, pieces in self.open:
                pieces.append(data)

    def lines(self) -> Iterator[str]:
        bare = lambda pieces: "".join(x.strip() for x in pieces)
        for tag, around, pieces, cells in self.out:
            if tag == "pre":
                yield f"\n```\n{''.join(pieces)}\n```\n"
            elif tag == "code":
                if around != "pre":
                    yield f"`{''.join(pieces)}`"
            elif tag == "tr":
                if cells:
                    yield "| " + " | ".join(map(bare, cells)) + " |"
            elif tag == "li":
                yield f"- {bare(pieces)}"
            elif tag != "p":
                yield f"\n{'#' * int(tag[1])} {bare(pieces)}\n"
            elif text := bare(pieces):
                yield f"\n{text}\n"


def html_markdown(text: str) -> str | None:
    p = _Html()
    p.feed(text)
    p.close()
    return "\n".join(p.lines()).strip() or None


#: Signs that lines over and under titles are made of, and the level of a title by the line under it.
TITLE_SIGNS, TITLE_LEVELS = set("=-~^\"'+`:.#*_"), {"=": 1, "-": 2, "~": 3, "^": 4, '"': 5}


#: What a line of reStructuredText can be, as bits; a line can be several.
_KINDS = {name: 1 << k for k, name in enumerate(("rule", "long", "titled", "directive", "inside"))}


def _any(*names: str) -> str:
    """A class of the letters that stand for lines which are all of these."""
    need = sum(_KINDS[n] for n in names)
    return "[" + "".join(chr(0x100 + bits) for bits in range(1 << len(_KINDS)) if bits & need == need) + "]"


#: Parts of a text, over one letter a line: a title between rules, one over a rule, a block behind a directive, any other line.
_RST = re.compile(f"(?P<between>{_any('rule', 'long')}.{_any('rule')})|(?P<over>{_any('titled')}.)|(?P<block>{_any('directive')}{_any('inside')}*)|(?P<other>.)", re.S)


def rst_markdown(text: str) -> str:
    """Titles with lines under or around them become headings, code blocks fences. A title between two lines has level 1, one over signs of another kind 2."""
    lines = text.splitlines()
    bare = [x.strip() for x in lines]
    rules = [bool(x) and not set(x) - TITLE_SIGNS for x in bare]
    under = [*rules[1:], False]

    def letter(k: int) -> str:
        is_ = {
            "rule": rules[k],
            "long": len(lines[k]) >= 2,
            "titled": bool(bare[k]) and not rules[k] and under[k] and len(lines[k].rstrip()) <= len(lines[k + 1]),
            "directive": bare[k] == "::" or re.match(r"\.\.\s+code-block::", lines[k]) is not None,
            "inside": not bare[k] or lines[k].startswith("   "),
        }
        return chr(0x100 + sum(_KINDS[n] for n, yes in is_.items() if yes))

    def part(found: re.Match) -> str:
        first, end = found.span()
        if found["between"]:
            return f"\n# {bare[first + 1]}\n"
        if found["over"]:
            return f"\n{'#' * TITLE_LEVELS.get(bare[first + 1][0], 2)} {bare[first]}\n"
        if found["block"]:
            code = range(first + 1, end)
            said = next((k for k in code if bare[k]), end)
            return "\n".join(["\n```", *(lines[k].removeprefix("   ") for k in range(said, end)), "```\n"])
        return lines[first]

    return "\n".join(part(m) for m in _RST.finditer("".join(map(letter, range(len(lines))))))


def json_markdown(text: str) -> str:
    try:
        text = json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        pass
    return f"```json\n{text}\n```"


def csv_markdown(text: str) -> str:
    """The first row as head; shorter rows are filled up, longer ones cut."""
    rows = list(csv.reader(io.StringIO(text)))
    if not rows:
        return "(empty)"
    width = len(rows[0])
    fit = lambda r: "| " + " | ".join((r + [""] * width)[:width]) + " |"
    return "\n".join([fit(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(fit, rows[1:])])


def docx_markdown(content: bytes) -> str | None:
    """Paragraphs of a word-processor file, headings and list items marked."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in body.iter(f"{space}p"):
        text = "".join(t.text or "" for t in p.iter(f"{space}t")).strip()
        style = next((s.get(f"{space}val", "").lower() for s in p.iter(f"{space}pStyle")), "")
        if text:
            level = re.match(r"heading ?(\d)", style)
            out.append("#" * int(level[1]) + f" {text}" if level else f"- {text}" if "list" in style or "bullet" in style else text)
    return "\n\n".join(out) or None


_PARSED: dict[str, Callable[[bytes], str | None]] = {
    "html": lambda b: html_markdown(b.decode("utf-8", "ignore")),
    "htm": lambda b: html_markdown(b.decode("utf-8", "ignore")),
    "rst": lambda b: rst_markdown(b.decode("utf-8", "ignore")),
    "json": lambda b: json_markdown(b.decode("utf-8", "ignore")),
    "csv": lambda b: csv_markdown(b.decode("utf-8", "ignore")),
    "docx": docx_markdown,
}


def parsed(rows: DataFrame, path: str, content: str) -> DataFrame:
    """path, markdown (null: unsupported or unreadable) of files whose format needs a parser."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p, b in zip(f["path"], f["content"], strict=True):
                try:
                    text = _PARSED[p.rsplit(".", 1)[-1].lower()](bytes(b))
                except Exception:  # a file that can't be read is skipped, as others must go on
                    text = None
                out.append(text)
            yield pd.DataFrame({"path": f["path"], "markdown": pd.Series(out, dtype=object)})

    return rows.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInPandas(work, "path string, markdown string")


def to_markdown(files: DataFrame) -> DataFrame:
    """path, text of files (path, content): by expression where one will do, parsed where not; files without text go."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    text = F.make_valid_utf8(F.col("content").cast("string")) if hasattr(F, "make_valid_utf8") else F.col("content").cast("string")
    plain = files.where(ext.isin("md", "txt", "yaml", "yml")).select("path", F.when(ext == "md", text).otherwise(titled(name, F.when(ext == "txt", text).otherwise(fenced(text, "yaml")))).alias("text"))
    rest = parsed(files.where(ext.isin(list(_PARSED))), "path", "content")
    page = F.when(ext == "rst", F.col("markdown")).otherwise(titled(name, F.col("markdown")))
    return plain.unionByName(rest.select("path", page.alias("text"))).where("text IS NOT NULL")


def page_parts(pages: DataFrame) -> DataFrame:
    """page_id, title, h1, n_links, n_items of pages (page_id, html), by patterns."""
    html = F.col("html")
    return pages.select("page_id", F.trim(F.regexp_extract(html, r"<title>([^<]*)</title>", 1)).alias("title"), F.trim(F.regexp_extract(html, r"<h1[^>]*>([^<]*)</h1>", 1)).alias("h1"), F.size(F.regexp_extract_all(html, F.lit(r"<a [^>]*href="), F.lit(0))).cast("long").alias("n_links"), F.size(F.regexp_extract_all(html, F.lit("<li[ >]"), F.lit(0))).cast("long").alias("n_items"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href of every link."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"""<a [^>]*href=["']([^"']*)["']"""), F.lit(1))).alias("pos", "href"))
