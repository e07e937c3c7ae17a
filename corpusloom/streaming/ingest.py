"""Streams: files that arrive become an index that is updated in place, and events become running counters, states and logs.

An index is Parquet in folders by batch. A batch writes the chunks of the files it has seen and nothing else, and a
batch that is run again after a failure overwrites its own folder. Readers take each source's newest batch.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corpusloom.operators.chunking import heading_chunks
from corpusloom.operators.incremental import upsert
from corpusloom.operators.usage import COUNTERS

EVENTS = "project long, ts timestamp, event_id long, kind string, tool string, hit boolean"
CHUNKS = "chunk_id string, source string, heading string, text string, modified timestamp, batch long"


def index_files(files: DataFrame, path: str, source: Column | None = None) -> DataStreamWriter:
    """Writes the chunks of a stream of files (path, content, modificationTime) below `path`.

    A file source sees each path once, so new versions of a file come in other folders; `source` says what they are
    versions of (by default the whole path). A source's newest batch replaces what it had: where a file is empty now, or
    its content null because it was deleted, a row without chunk says so. Of several versions in a batch the last
    modified counts.
    """
    source = F.col("path") if source is None else source

    def batch(rows: DataFrame, number: int) -> None:
        seen = rows.select(source.alias("source"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("modificationTime").alias("modified"))
        last = upsert(seen.where("false"), seen, "source", "modified")
        chunks = heading_chunks(last, "source", "text").dropDuplicates(["chunk_id"]).select("chunk_id", "source", "heading", "text")
        last.select("source", "modified").join(chunks, "source", "left").select("chunk_id", "source", "heading", "text", "modified").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(batch)


def live_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of each source's newest batch below path; none if nothing was written yet."""
    try:
        rows = spark.read.schema(CHUNKS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CHUNKS)
    newest = rows.groupBy("source").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["source", "batch"], "left_semi").where("chunk_id IS NOT NULL").select(*[f.split()[0] for f in CHUNKS.split(", ")])


def append_events(events: DataFrame, path: str) -> None:
    """Adds events to a log of JSON lines by day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def event_log(spark: SparkSession, path: str, project: int | None = None) -> DataFrame:
    """A log's events, of one project or all; lines that are no events are skipped."""
    e = spark.read.schema(f"{EVENTS}, day date").option("mode", "DROPMALFORMED").json(path)
    return e if project is None else e.where(F.col("project") == project)


def event_counters(events: DataFrame) -> DataFrame:
    """Running counters of a stream of events, for update or complete mode."""
    return events.groupBy("project").agg(*[F.count_if(F.col("tool").isin(v)).alias(k) for k, v in COUNTERS.items()], F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def windowed_hits(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Searches and hits a window of time; events later than `late` are dropped. Goes beyond the batch operators, which have no windows."""
    e = events.withWatermark("ts", late).where("kind = 'search_result'")
    return e.groupBy("project", F.window("ts", size).alias("w")).agg(F.count("*").alias("searches"), F.count_if(F.col("hit")).alias("hits")).select("project", F.col("w.start").alias("start"), "searches", "hits")


def last_states(events: DataFrame, state: Column) -> DataFrame:
    """Per project, the last state that is not `unknown`, over a stream, for update or complete mode."""
    e = events.select("project", "ts", "event_id", state.alias("state")).where("state <> 'unknown'")
    return e.groupBy("project").agg(F.max(F.struct("ts", "event_id", "state")).alias("s")).select("project", "s.state")


def rate_limited(events: DataFrame, seconds: int = 60) -> DataFrame:
    """project, ts, event_id of the events of a stream that come at least `seconds` after the last one let through, the first one always.

    The time let through last is the state of a project. Events of a batch are taken in order of (ts, event_id).
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples(index=False):
            at = r.ts.timestamp()
            if last is None or at - last >= seconds:
                last = at
                out.append((key[0], r.ts, r.event_id))
        state.update((last,))
        yield pd.DataFrame(out, columns=["project", "ts", "event_id"])

    e = events.where("project IS NOT NULL AND ts IS NOT NULL").select("project", "ts", "event_id").groupBy("project")
    return e.applyInPandasWithState(update, "project long, ts timestamp, event_id long", "last double", "append", GroupStateTimeout.NoTimeout)


def streaks(events: DataFrame, failed: str = "failure", ok: str = "success") -> DataFrame:
    """Per project, failures since the last success, kept as state over a stream; a row for each project and batch. Events of a batch are taken in order of (ts, event_id)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key, frames, state: GroupState):
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind in rows["kind"]:
            n = 0 if kind == ok else n + 1
        state.update((n,))
        yield pd.DataFrame({"project": [key[0]], "streak": [n]})

    kept = events.where(F.col("kind").isin(failed, ok)).select("project", "ts", "event_id", "kind")
    return kept.groupBy("project").applyInPandasWithState(update, "project long, streak long", "streak long", "update", GroupStateTimeout.NoTimeout)
