"""Column functions over texts: hashes, slugs, tokens, Markdown measures, frontmatter. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common English words that carry no meaning in a search.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]
TOKEN = r"[\p{L}\p{N}_]{2,}"
SPACE = r"[ \t\n\x0B\f\r]"
FENCE = "(?ms)^```.*?^```"


def chunk_id(source: Column, text: Column) -> Column:
    """16 hexadecimal digits that stand for a chunk of a source."""
    return F.left(F.sha2(F.concat_ws("\n", source, text), 256), F.lit(16))


def content_hash(text: Column) -> Column:
    return F.md5(text)


def slug(text: Column, sign: str = "-", most: int = 60) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one sign, none at either end, `most` characters."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", sign), f"^{sign}+|{sign}+$", ""), F.lit(most))


def version_slug(text: Column) -> Column:
    """Like slug, but capital letters are replaced and not lower-cased."""
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tokens(text: Column) -> Column:
    """Lower-case tokens of two word characters or more that aren't stop words, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(STOP_WORDS))


def char_count(text: Column) -> Column:
    return F.length(text).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(SPACE.replace("[", "[^") + "+"), F.lit(0))).cast("long")


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def without_fences(text: Column) -> Column:
    return F.regexp_replace(text, FENCE, "")


#: What is taken out of a Markdown text to measure what it says, in this order. S: white space within a line.
_S = r"[ \t\x0B\f\r]"
OVERHEAD = [
    (rf"(?m)^#{{1,6}}{_S}+.*$\n?", ""),
    (rf"(?m)^{_S}*(?:---+|\*\*\*+|___+){_S}*$\n?", ""),
    (rf"(?m)^{_S}*[-*+]{_S}+", ""),
    (rf"(?m)^{_S}*[0-9]+\.{_S}+", ""),
    (rf"(?m)^(?:{_S}*>{_S}*)+", ""),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"`([^`]*)`", "$1"),
    (r"\*\*([^*]*)\*\*", "$1"),
    (r"\*([^*]*)\*", "$1"),
    (r"__([^_]*)__", "$1"),
    (r"_([^_]*)_", "$1"),
    (r"\n{2,}", "\n"),
]


def meaningful_text(text: Column) -> Column:
    """What a Markdown text says: no fences, headings, rules, list signs, quote signs and inline marks."""
    out = without_fences(text)
    for pattern, to in OVERHEAD:
        out = F.regexp_replace(out, pattern, to)
    return stripped(out)


def plain_heading(text: Column) -> Column:
    """A heading without marks, pictograms and white space at either end."""
    signs = r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}\x{1FA00}-\x{1FAFF}]+"
    return stripped(F.regexp_replace(F.regexp_replace(text, r"[*_`~]+", ""), signs, ""))


def comma_list(text: Column) -> Column:
    """The parts of a comma-separated list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def masked(secret: Column) -> Column:
    """The first eight characters of a secret; null and empty stay."""
    return F.when(F.length(secret) > 0, F.concat(F.left(secret, F.lit(8)), F.lit("..."))).otherwise(secret)


def frontmatter(text: Column) -> Column:
    """The block between leading `---` lines, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"\A---[ \t]*\n((?s:.*?))\n---[ \t]*(?:\n|\z)", 1), F.lit(""))


def without_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"\A---[ \t]*\n(?s:.*?)\n---[ \t]*(?:\n|\z)", "")


def _bare(raw: Column) -> Column:
    """A scalar's text: trimmed and unquoted; null for `null`, `~` and an empty one."""
    plain = F.trim(raw)
    return F.when(~F.lower(plain).isin("null", "~", ""), F.regexp_replace(plain, r"""^(?:"(.*)"|'(.*)')$""", "$1$2"))


def scalar_kind(raw: Column) -> Column:
    """null, bool, int or str, as a scalar is written."""
    plain = F.trim(raw)
    return F.when(F.lower(plain).isin("null", "~", ""), "null").when(F.lower(plain).isin("true", "false"), "bool").when(plain.rlike("^-?[0-9]+$"), "int").otherwise("str")


def frontmatter_entries(block: Column) -> Column:
    """An array of struct(key, kind, value, items) of a block's keys at the left edge, in order; comments and what else is indented are left out.

    kind is null, bool, int, str or list. A list stands in brackets or as indented `- ` lines under its key; value and
    items hold text, unquoted and, for scalars, without a comment; an item of a block that is `null` or `~` says `None`, a
    bare dash is an empty one. A key may come again; the last one counts.
    """
    line = r"(?m)^([^\s#:][^:\n]*):([^\n]*(?:\n(?:[ \t]+[^\n]*|(?=\n|\z)))*)"
    keys, rests = F.regexp_extract_all(block, F.lit(line), F.lit(1)), F.regexp_extract_all(block, F.lit(line), F.lit(2))

    def entry(key: Column, rest: Column) -> Column:
        said = F.trim(F.regexp_replace(F.regexp_extract(rest, r"\A([^\n]*)", 1), r"#.*$", ""))
        under = F.regexp_extract(rest, r"\A[^\n]*((?:\n[ \t]*(?:-[ \t][^\n]*|-?[ \t]*))*)", 1)
        marked = F.transform(F.regexp_extract_all(under, F.lit(r"(?m)^[ \t]+-(?:[ \t]+([^\n]*))?$"), F.lit(1)), lambda x: F.when(F.trim(x) == "", "").otherwise(F.coalesce(_bare(x), F.lit("None"))))
        flow = F.filter(F.transform(F.split(F.regexp_replace(said, r"^\[|\]$", ""), ","), _bare), lambda x: x.isNotNull())
        in_brackets = said.startswith("[") & said.endswith("]")
        listed = in_brackets | ((said == "") & (F.size(marked) > 0))
        kind = F.when(listed, "list").otherwise(scalar_kind(said))
        items = F.when(in_brackets, flow).when(listed, marked).otherwise(F.array().cast("array<string>"))
        return F.struct(F.trim(key).alias("key"), kind.alias("kind"), F.when(~listed, _bare(said)).alias("value"), items.alias("items"))

    return F.zip_with(keys, rests, entry)


def frontmatter_scalar(block: Column, key: str) -> Column:
    """A scalar's text: unquoted, without comment; null for `null`, `~`, an empty one or none."""
    raw = F.trim(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*([^\n#\[]*)", 1))
    plain = F.regexp_replace(raw, r"""^(["'])(.*)\1$""", "$2")
    return F.when(F.lower(plain).isin("null", "~", ""), F.lit(None).cast("string")).otherwise(plain)


def frontmatter_list(block: Column, key: str) -> Column:
    """A list's items, in flow form (`[a, b]`) or as a block of `- ` lines; a scalar is a list of one."""
    flow = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\[([^\]\n]*)\]", 1)
    lines = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*- [^\n]*\n?)+)", 1)
    one = frontmatter_scalar(block, key)
    bare = lambda x: F.regexp_replace(F.trim(x), r"""^["']|["']$""", "")
    items = F.when(flow != "", F.split(flow, ",")).when(lines != "", F.transform(F.regexp_extract_all(lines, F.lit(r"(?m)^[ \t]*- ([^\n]*)$"), F.lit(1)), lambda x: F.trim(x))).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(items, bare), lambda x: x != "")


def rounded(x: Column, digits: int = 6) -> Column:
    """Half up, by floor, so that every engine says the same."""
    return F.floor(x * F.lit(10.0**digits) + F.lit(0.5)).cast("double") / F.lit(10.0**digits)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; 0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))
