"""Running summaries of projects that are mirrored at most once in a while, and that a lost state finds again in its mirror.

A project's counters are the state of a stream of events; they live in the stream's checkpoint and go on when it is
restarted. A row for the mirror leaves at the first event, and then no sooner than `gap` after the last one: what
comes in between sets a timer, so that the last counts are mirrored, too, though nothing may come any more. If the checkpoint is lost, a new
stream begins with what the mirror says of each project (hydration); for a project that has a state, the state wins.

The state store must be RocksDB's (`spark.sql.streaming.stateStore.providerClass`), which timers and lists need.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from corpusloom.operators.usage import COUNTERS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value: seconds between two mirror writes of a project.
GAP = 60
FIELDS = ["total_calls", *COUNTERS, "writes", "misses", "reports", "found", "blocking", "fixed"]
SUMMARY = ", ".join(f"{f} long" for f in FIELDS) + ", last_tool string"
MIRRORED = f"project long, updated_ms long, {SUMMARY}"


def counted(so_far: dict, tool: str | None, hit: bool | None, kind: str | None, found: int, blocking: int, fixed: int) -> None:
    """Adds an event to a project's counters."""
    if kind == "tool_call" and tool:
        so_far["total_calls"] += 1
        so_far["last_tool"] = tool
        name = next((k for k, tools in COUNTERS.items() if tool in tools), "writes" if tool.startswith("write_") else None)
        if name:
            so_far[name] += 1
    elif kind == "search_result" and hit is False:
        so_far["misses"] += 1
    elif kind == "guardrail_report":
        so_far["reports"] += 1
        for k, n in (("found", found), ("blocking", blocking), ("fixed", fixed)):
            so_far[k] += max(0, int(n or 0))


class Mirror(StatefulProcessor):
    """Counters of a project, and when they were mirrored last."""

    def __init__(self, gap: float = GAP, forget_hours: int | None = None):
        self.gap, self.forget_hours = gap, forget_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = self.forget_hours * 3_600_000 if self.forget_hours else None
        self.summary = handle.getValueState("summary", SUMMARY, ttl)
        self.mirrored = handle.getValueState("mirrored", "at long, waits boolean", ttl)

    def _now(self) -> dict:
        if not self.summary.exists():
            return dict.fromkeys(FIELDS, 0) | {"last_tool": None}
        return dict(zip([*FIELDS, "last_tool"], self.summary.get(), strict=True))

    def _row(self, key: tuple, at: int, so_far: dict) -> pd.DataFrame:
        self.mirrored.update((at, False))
        return pd.DataFrame([{"project": key[0], "updated_ms": at} | so_far])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        so_far = self._now()
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples(index=False):
            plain = lambda x: None if pd.isna(x) else x
            counted(so_far, plain(r.tool), plain(r.hit), r.kind, *(plain(x) for x in (r.found, r.blocking, r.fixed)))
        self.summary.update(tuple(so_far[f] for f in [*FIELDS, "last_tool"]))
        at = timerValues.getCurrentProcessingTimeInMs()
        last, waits = self.mirrored.get() if self.mirrored.exists() else (None, False)
        if last is None or at - last >= self.gap * 1000:
            yield self._row(key, at, so_far)
        elif not waits:
            self.handle.registerTimer(int(last + self.gap * 1000))
            self.mirrored.update((last, True))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, waits = self.mirrored.get() if self.mirrored.exists() else (None, False)
        if waits:
            yield self._row(key, timerValues.getCurrentProcessingTimeInMs(), self._now())

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        so_far = {f: int(row[f]) for f in FIELDS} | {"last_tool": None if pd.isna(row["last_tool"]) else row["last_tool"]}
        self.summary.update(tuple(so_far[f] for f in [*FIELDS, "last_tool"]))

    def close(self) -> None:
        pass


def mirrors(spark: SparkSession, path: str) -> DataFrame:
    """What the mirror says of each project: its newest row."""
    try:
        rows = spark.read.schema(f"{MIRRORED}, writer string, batch long").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MIRRORED)
    newest = rows.groupBy("project").agg(F.max_by(F.struct("updated_ms", *FIELDS, "last_tool"), F.struct("updated_ms", "batch")).alias("s"))
    return newest.where("project IS NOT NULL").select("project", "s.*")


def mirrored_summaries(events: DataFrame, path: str, gap: float = GAP, forget_hours: int | None = None) -> DataStreamWriter:
    """Keeps the counters of a stream of events (project, ts, event_id, kind, tool, hit, found, blocking, fixed) and writes mirror rows below path.

    Rows of a batch go to a folder of the query's id, which its checkpoint keeps, and the batch's number; a batch that is
    run again overwrites its own and no other's. forget_hours: a project
    without events for so long loses its state; its mirror stays. The mirror as it is when the stream begins hydrates a new state.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kept = events.where("project IS NOT NULL").select("project", "ts", "event_id", "kind", "tool", "hit", "found", "blocking", "fixed")
    start = mirrors(spark, path).groupBy("project")
    rows = kept.groupBy("project").transformWithStateInPandas(Mirror(gap, forget_hours), MIRRORED, "Update", "ProcessingTime", start)

    def batch(out: DataFrame, number: int) -> None:
        writer = out.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        out.coalesce(1).write.mode("overwrite").json(f"{path}/writer={writer}/batch={number}")

    return rows.writeStream.outputMode("update").foreachBatch(batch)


def reset(spark: SparkSession, path: str, project: int, at_ms: int) -> None:
    """Writes zeros for a project to the mirror at once, whatever the gap; its events stay as they are."""
    zeros = spark.createDataFrame([(project, at_ms, *[0] * len(FIELDS), None)], MIRRORED)
    zeros.coalesce(1).write.mode("error").json(f"{path}/writer=reset-{uuid.uuid4().hex}/batch=0")
