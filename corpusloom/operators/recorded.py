"""Searches that record themselves, and reports from outside, as events in a log that counters and nudges are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.operators import usage
from corpusloom.sources.store import written

#: Which type of chunks a tool searches; None: all.
TOOLS = {"search_docs": None, "search_bugfixes": "bugfix", "search_tests": "test", "search_by_type": None}
EVENT = "project long, ts timestamp, event_id long, kind string, tool string, hit boolean, result_count long, found long, blocking long, fixed long, baseline double, actual double"


def _appended(events: DataFrame, log: str) -> None:
    have = set(events.columns)
    kinds = [f.split(" ") for f in EVENT.split(", ")]
    whole = events.select(*[(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds])
    whole.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(log)


def log_of(spark, log: str, project: int | None = None) -> DataFrame:
    """A log's events; lines that are none are skipped."""
    e = spark.read.schema(f"{EVENT}, day date").option("mode", "DROPMALFORMED").json(log).drop("day")
    return e if project is None else e.where(F.col("project") == project)


def searched(search: Callable[[DataFrame, str | None], DataFrame], queries: DataFrame, tool: str, log: str, at: str, kind: str | None = None) -> tuple[DataFrame, dict]:
    """The hits of queries (qid, project, text), and how many there were: {"results": ..., "asked": ...}.

    search: from queries and a type of chunks to hits (qid, ...); it runs once. Its result is written, and counted while it is. For each query
    two events go to the log: the call of the tool and its result, a hit if it has a row. Its project may be null.
    """
    if tool not in TOOLS:
        raise ValueError(f"{tool} is none of {sorted(TOOLS)}")
    results, asked = Observation("results"), Observation("asked")
    q = written(queries.select("qid", "project", "text").observe(asked, F.count("*").alias("n")), "asked")
    hits = written(search(q, kind or TOOLS[tool]).observe(results, F.count("*").alias("n")), "hits")
    per = q.join(hits.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").select("qid", "project", F.coalesce("n", F.lit(0)).alias("n"))
    two = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("step"), h.alias("hit"), n.alias("result_count")) for i, (k, h, n) in enumerate([("tool_call", F.lit(None).cast("boolean"), F.lit(None).cast("long")), ("search_result", F.col("n") > 0, F.col("n").cast("long"))])])
    e = per.select("project", F.lit(at).cast("timestamp").alias("ts"), "qid", F.lit(tool).alias("tool"), F.explode(two).alias("e"))
    _appended(e.select("project", "ts", (F.col("qid").cast("long") * 2 + F.col("e.step")).alias("event_id"), "tool", "e.kind", "e.hit", "e.result_count"), log)
    return hits, {"results": results.get["n"], "asked": asked.get["n"]}


def guardrail_reports(reports: DataFrame, log: str) -> DataFrame:
    """Appends reports (project, ts, event_id, found, blocking, fixed, baseline, actual) to the log, and returns what was recorded: counts below 0, or none, are 0."""
    at_least = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")).alias(c)
    kept = reports.select("project", "ts", "event_id", F.lit("guardrail_report").alias("kind"), *map(at_least, ("found", "blocking", "fixed")), "baseline", "actual")
    kept = written(kept, "reports")
    _appended(kept, log)
    return kept.drop("kind")


def counters(events: DataFrame) -> DataFrame:
    """Per project, the counters of a log: a call counts by its event, and so do hits and misses by theirs."""
    call = F.col("kind") == "tool_call"
    own = events.withColumn("tool", F.when(call, F.col("tool"))).withColumn("hit", F.when(F.col("kind") == "search_result", F.col("hit")))
    return usage.counters(own)


def nudged(events: DataFrame) -> DataFrame:
    """project, nudge: the advice that a log's counters call for."""
    return usage.nudges(counters(events))
