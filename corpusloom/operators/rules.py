"""Rules on lines: which line of which file breaks which rule, as a gate on what is written."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """name, description, pattern (Java's and RE2's common syntax), and a word in lower case that any line it matches holds."""

    name: str
    description: str
    pattern: str
    keyword: str


RULES = [
    Rule("access-key", "Access key id of a cloud provider", r"AKIA[A-Z0-9]{16,}", "akia"),
    Rule("assigned-secret", "Value assigned to a password, secret, token or key", r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9+/_.=-]{6,}", ""),
    Rule("private-key", "Private key block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "private key"),
    Rule("long-hex", "Long hexadecimal value", r"\b[0-9a-f]{32,}\b", ""),
    Rule("mail", "Mail address", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "@"),
]


def findings(files: DataFrame, rules: list[Rule] = RULES, allowed: tuple[str, ...] = ()) -> DataFrame:
    """file, line (from 1), rule, description of files (file, text); no matched text leaves.

    A file is read once. A line that holds no rule's keyword is told by one pattern and goes before any rule is tried; of the others each rule
    is tried whose keyword they hold. Rules without keyword are part of that first pattern as they are. A
    line breaks a rule once, however often it matches. allowed: patterns of lines that are let through. Null texts have no lines.
    """
    if not rules:
        return files.sparkSession.createDataFrame([], "file string, line int, rule string, description string")
    first = "|".join(f"(?i:{re.escape(r.keyword)})" if r.keyword else f"(?:{r.pattern})" for r in rules)
    lines = files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("at", "said"))
    lines = lines.where(F.col("said").rlike(first))
    for pattern in allowed:
        lines = lines.where(~F.col("said").rlike(pattern))
    low = F.lower("said")
    broken = F.array_compact(F.array(*[F.when((low.contains(r.keyword) if r.keyword else F.lit(True)) & F.col("said").rlike(r.pattern), F.struct(F.lit(r.name).alias("rule"), F.lit(r.description).alias("description"))) for r in rules]))
    return lines.select("file", (F.col("at") + 1).alias("line"), F.explode(broken).alias("r")).select("file", "line", "r.rule", "r.description")


def gate(files: DataFrame, mode: str = "block", rules: list[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """Files that may be written, and what was found. mode: block (files with findings stay out), warn (all pass), off (nothing is looked for)."""
    if mode not in ("block", "warn", "off"):
        raise ValueError(f"mode {mode} is not block, warn or off")
    found = findings(files, [] if mode == "off" else rules)
    return (files.join(found.select("file").distinct(), "file", "left_anti") if mode == "block" else files), found
