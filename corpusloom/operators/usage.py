"""Usage telemetry: impact, counters, nudges, streaks and states per key, of events (project, ts, event_id, kind, tool, hit, ...)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import rounded

#: Minutes a hit and a fixed violation save; which counter a tool adds to.
MINUTES_HIT, MINUTES_FIXED = 2.5, 15
COUNTERS = {
    "searches": ["search_docs", "search_by_type", "search_tests"],
    "bugfix_searches": ["search_bugfixes"],
    "bugfix_writes": ["write_bugfix_summary"],
    "session_saves": ["save_session_summary"],
}
UNHEALTHY_STREAK = 3


def recent(events: DataFrame, days: int) -> DataFrame:
    """Events of the last `days` (1 to 365) before the latest one."""
    days = min(max(days, 1), 365)
    until = events.agg(F.max("ts").alias("until"))
    return events.crossJoin(F.broadcast(until)).where(F.col("ts") >= F.col("until") - F.make_dt_interval(F.lit(days))).drop("until")  # one row


def impact(events: DataFrame, days: int = 30) -> DataFrame:
    """Per project: searches, hits, reports, found, blocking and fixed violations, minutes observed and estimated, hours."""
    report, hit = F.col("kind") == "guardrail_report", (F.col("kind") == "search_result") & F.col("hit")
    saved = F.when(report & (F.col("baseline") > F.col("actual")), F.col("baseline") - F.col("actual")).otherwise(F.lit(0.0))
    of = lambda c: F.sum(F.when(report, F.col(c)).otherwise(F.lit(0))).cast("long")
    a = recent(events, days).groupBy("project").agg(F.count_if(report).alias("reports"), F.count_if(F.col("kind") == "search_result").alias("searches"), F.count_if(hit).alias("hits"), of("found").alias("found"), of("blocking").alias("blocking"), of("fixed").alias("fixed"), F.sum(saved).alias("observed"))
    total = F.col("observed") + MINUTES_HIT * F.col("hits") + MINUTES_FIXED * F.col("fixed")
    return a.select("project", "searches", "reports", "hits", "found", "blocking", "fixed", rounded(F.col("observed"), 2).alias("minutes_observed"), rounded(total, 2).alias("minutes_saved"), rounded(total / 60, 2).alias("hours_saved"))


def counters(events: DataFrame) -> DataFrame:
    """Per project: calls, a count for each kind of tool, hits, misses, hit rate, the last tool, and reports with their violations."""
    n = {k: F.count_if(F.col("tool").isin(v)) for k, v in COUNTERS.items()}
    other = F.count_if(F.col("tool").startswith("write_") & (F.col("tool") != "write_bugfix_summary"))
    hits, misses = F.count_if(F.col("hit")), F.count_if(~F.col("hit"))
    last = F.max(F.when(F.col("tool").isNotNull(), F.struct("ts", "event_id", "tool")))["tool"]
    report = F.col("kind") == "guardrail_report"
    of = lambda c: F.coalesce(F.sum(F.when(report, F.greatest(F.col(c), F.lit(0)))), F.lit(0)).cast("long")
    reports = [F.count_if(report).alias("reports"), of("found").alias("found"), of("blocking").alias("blocking"), of("fixed").alias("fixed")]
    return events.groupBy("project").agg(F.count_if(F.col("tool").isNotNull()).alias("total_calls"), *reports, *[c.alias(k) for k, c in n.items()], other.alias("writes"), hits.alias("hits"), misses.alias("misses"), rounded(F.try_divide(hits, hits + misses)).alias("hit_rate"), last.alias("last_tool"))


def nudges(counted: DataFrame) -> DataFrame:
    """project and the advice that its counters call for, one row each."""
    rules = {
        "write down bug fixes": (F.col("bugfix_searches") >= 1) & (F.col("bugfix_writes") == 0),
        "write down what you learn": (F.col("searches") >= 5) & (F.col("writes") == 0) & (F.col("bugfix_writes") == 0),
        "fill the gaps": F.col("misses") >= 3,
    }
    return counted.select("project", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("nudge"))


def failure_streaks(events: DataFrame, key: str, failed: Column) -> DataFrame:
    """Per key: failures since the last success, and whether that is still healthy.

    The last success is a maximum and the failures behind it a count: no window over a key's events is needed.
    """
    at = F.struct("ts", "event_id")
    e = events.select(key, at.alias("at"), failed.alias("failed"))
    last = e.groupBy(key).agg(F.max(F.when(~F.col("failed"), F.col("at"))).alias("ok"))
    n = e.where("failed").join(last, key).where("ok IS NULL OR at > ok").groupBy(key).agg(F.count("*").alias("streak"))
    return last.join(n, key, "left").select(key, F.coalesce("streak", F.lit(0)).alias("streak"), (F.coalesce("streak", F.lit(0)) < UNHEALTHY_STREAK).alias("healthy"))


def last_known(events: DataFrame, key: str, state: Column) -> DataFrame:
    """Per key, the last state that is not `unknown`."""
    return events.select(key, "ts", "event_id", state.alias("state")).where("state <> 'unknown'").groupBy(key).agg(F.max(F.struct("ts", "event_id", "state"))["state"].alias("state"))


def divergence(ahead: Column, behind: Column) -> Column:
    """The state of a branch by the commits that either side lacks; null counts mean that there is nothing to compare with."""
    return F.when(ahead.isNull() | behind.isNull(), "no-upstream").when((ahead == 0) & (behind == 0), "synced").when(behind == 0, "ahead").when(ahead == 0, "behind").otherwise("diverged")


def rate_limited(events: DataFrame, key: str, seconds: int = 60) -> DataFrame:
    """key, n_events, n_emitted: an event is emitted at least `seconds` after the last one emitted, the first one always.

    What is emitted depends on what was emitted before, so a key's events are read in order, a batch at a time: they
    are sorted by Spark and never held together.
    """

    def work(frames):
        now, n, out, last = None, 0, 0, None
        for f in frames:
            for k, t in zip(f["k"].to_numpy(), f["t"].to_numpy(), strict=True):
                if k != now:
                    if n:
                        yield pd.DataFrame({"k": [now], "n": [n], "emitted": [out]})
                    now, n, out, last = k, 0, 0, None
                n += 1
                if last is None or t - last >= seconds:
                    out, last = out + 1, t
        if n:
            yield pd.DataFrame({"k": [now], "n": [n], "emitted": [out]})

    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    e = events.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), t.alias("t"), "event_id").repartition("k").sortWithinPartitions("k", "t", "event_id")
    return e.select("k", "t").mapInPandas(work, "k long, n long, emitted long").select(F.col("k").alias(key), F.col("n").alias("n_events"), F.col("emitted").alias("n_emitted"))


def hydrate(hot: DataFrame, mirror: DataFrame, key: str) -> DataFrame:
    """The hot tier, and of the mirror what it lacks."""
    return hot.unionByName(mirror.join(hot, key, "left_anti"))


def searches(events: DataFrame, tools: list[str]) -> DataFrame:
    """Per project: searches, hits, misses, by_tool (a count for each of `tools`, in their order) and the time of the last one."""
    e = events.where("kind = 'search_result'")
    by = F.map_from_arrays(F.array(*map(F.lit, tools)), F.array(*[F.count_if(F.col("tool") == t) for t in tools]))
    return e.groupBy("project").agg(F.count("*").alias("searches"), F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses"), by.alias("by_tool"), F.max("ts").alias("last_search"))


def degraded(streaks: DataFrame, key: str, group: Column) -> DataFrame:
    """project, n, degraded: how many keys a project has, and a sorted list of those that are not healthy."""
    return streaks.groupBy(group.alias("project")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(~F.col("healthy"), F.col(key)))).alias("degraded"))


def progress(done: Column, total: Column) -> Column:
    """How far a job is, in whole per cent, halves going to the even number; 0 of nothing."""
    return F.coalesce(F.bround(F.try_divide(done * 100.0, total), 0), F.lit(0.0)).cast("long")
