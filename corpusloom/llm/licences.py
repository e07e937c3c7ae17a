"""License scans: whole texts, normalised, are looked up by digest among known licences.

A text's canonical form drops copyright lines, lower-cases, maps equivalent spellings to one and turns every run of
signs and white space into one space. Its SHA-256 joins the digests of known texts, so a scan costs one pass and one
lookup. The same lookup is made for each line as a text of its own, which finds notices inside other prose.

The known licences are a table (license_id, text) of any size; its digests are sent to all executors only if their
measured bytes are within a bound. `known_licences` reads whole bodies and standard headers from `licence_texts` (files
<license_id>[--<part>].txt), with their usual titles, and adds SPDX tags and `NOTICES`, short ones that stand in texts as a line.

Nulls: a null or empty text, and one of signs only, matches nothing and has a null digest. Known rows with null text
are skipped; where known texts share a canonical form, the least id names it. Repeated rows each get their row.
"""

from __future__ import annotations

import re
import textwrap
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import doc_key, sized, written

COPYRIGHT_LINE = r"(?im)^[ \t]*(?:copyright\b|\(c\)|©)[^\n]*$"
#: The same behind comment signs or other signs. The registered SQL keeps the plain form.
HOLDER_LINE = r"(?im)^[^\p{L}\p{N}\n]*?(?:copyright\b|\(c\)|©)[^\n]*$"
#: Pairs of equivalent spellings, the second one being canonical.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "favour": "favor", "fulfil": "fulfill", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "licence": "license", "licenced": "licensed", "optimisation": "optimization", "organisation": "organization", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
#: Notices by which texts name their licence.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}

TEXTS = Path(__file__).with_name("licence_texts")
#: Titles that stand above bodies which don't hold their own.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "All rights reserved.", "BSD 2-Clause License\n\nAll rights reserved."],
    "BSD-3-Clause": ["BSD 3-Clause License", "All rights reserved.", "BSD 3-Clause License\n\nAll rights reserved."],
    "ISC": ["ISC License", "The ISC License"],
    "Zlib": ["zlib License", "The zlib License"],
}


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line, without empty ones. Nested transforms make each step once a line."""
    plain = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(HOLDER_LINE), F.lit("")).otherwise(F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))))

    def spelt(x: Column) -> Column:
        out = x
        for said, to in SPELLINGS.items():
            out = F.regexp_replace(out, rf"\b{said}\b", to)
        return F.when(x.rlike(rf"\b(?:{'|'.join(SPELLINGS)})\b"), out).otherwise(x)

    return F.transform(F.filter(plain, lambda x: x != ""), spelt)


def whole_digest(lines: Column) -> Column:
    """The digest of a text by its canonical lines, null if there are none."""
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " "), 256))


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTICES.items()), "license_id string, text string")


def _wrapped(text: str) -> list[str]:
    """A short text as it is and at other widths, where a line may begin with `copyright` or not; of long ones, the text."""
    if len(text) > 5000:
        return [text]
    parts = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
    wide = ["\n\n".join(textwrap.fill(p, w, break_long_words=False, break_on_hyphens=False) for p in parts) for w in (*range(64, 84), 100_000)]
    begins = lambda t: tuple(re.findall(r"(?im)^\W*?(?:copyright\b|\(c\)|©).*$", t))
    return list({begins(t): t for t in [*wide, text]}.values())


def known_licences(spark: SparkSession) -> DataFrame:
    """license_id, text: whole bodies with and without titles, standard headers, SPDX tags and notices."""
    rows = list(NOTICES.items())
    for f in sorted(TEXTS.glob("*.txt")):
        name, body = f.stem.split("--")[0], f.read_text(encoding="utf-8")
        bodies = [body]
        if name.startswith("BSD"):
            bodies.append(re.sub(r"(?m)^(\s*)\d\. ", r"\1* ", body))  # clauses without numbers
        if "END OF TERMS AND CONDITIONS" in body:
            bodies.append(body[: body.index("END OF TERMS AND CONDITIONS") + 27])  # without the guide for users
        rows += [(name, f"{title}\n\n{t}") for b in bodies for t in _wrapped(b) for title in ["", *TITLES.get(name, [])]]
    for name in sorted({name for name, _ in rows}):
        gnu = [name, f"{name}-only", f"{name}-or-later", f"{name}+"] if "GPL" in name or "GFDL" in name else [name]
        rows += [(name, f"SPDX-License-Identifier: {tag}") for tag in gnu]
    return spark.createDataFrame(rows, "license_id string, text string")


def digests(known: DataFrame) -> DataFrame:
    """digest, license_id: once for each canonical form."""
    k = known.select(canonical_lines(known["text"]).alias("lines"), known["license_id"].alias("license_id"))
    return k.select(whole_digest(F.col("lines")).alias("digest"), "license_id").where("digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, digest, license_id (of the whole text), line_licenses (comma-joined, sorted), n_license_lines."""
    look, small = sized(written(digests(known), "known"), F.lit(120))
    wide = F.broadcast(look) if small else look
    text = docs[text_col]
    c = docs.select(docs[id_col].alias("doc_id"), doc_key(docs[id_col], F.coalesce(text, F.lit(""))).alias("doc"), canonical_lines(text).alias("lines"))
    # normalised and digested once: the whole text's digest and the lines' are read from there
    c = written(c.select("doc_id", "doc", whole_digest(F.col("lines")).alias("digest"), F.transform("lines", lambda x: F.unhex(F.sha2(x, 256))).alias("lines")), "digests")
    d = c.select("doc_id", "doc", "digest")
    short = look.select(F.unhex("digest").alias("key"), "license_id")
    found = c.select("doc", F.posexplode("lines").alias("line", "key")).join(F.broadcast(short) if small else short, "key").groupBy("doc", "line").agg(F.first("license_id").alias("license_id"))
    by = found.groupBy("doc").agg(F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("line_licenses"), F.count("*").alias("n_license_lines"))
    out = d.join(wide, "digest", "left").join(by, "doc", "left")
    return out.select("doc_id", "digest", "license_id", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"))


def oracle() -> str:
    def form(x: str) -> str:
        out = rf"trim(regexp_replace(lower(regexp_replace({x}, '{COPYRIGHT_LINE}', ' ', 'g')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
        for said, to in SPELLINGS.items():
            out = rf"regexp_replace({out}, '\b{said}\b', '{to}', 'g')"
        return f"sha256(nullif({out}, ''))"

    known = " UNION ALL ".join(f"SELECT '{k}' AS license_id, '{v}' AS text" for k, v in NOTICES.items())
    return f"""
WITH k AS (SELECT {form('text')} AS digest, min(license_id) AS license_id FROM ({known}) GROUP BY 1),
d AS (SELECT doc_id, text, {form('text')} AS digest FROM documents),
l AS (SELECT doc_id, {form('line')} AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses, count(*) AS n_license_lines FROM l JOIN k USING (digest) GROUP BY doc_id)
SELECT doc_id, digest, license_id, coalesce(line_licenses, '') AS line_licenses, coalesce(n_license_lines, 0) AS n_license_lines
FROM d LEFT JOIN k USING (digest) LEFT JOIN n USING (doc_id)"""
