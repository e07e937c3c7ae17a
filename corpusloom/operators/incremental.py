"""Incremental indexing: what changed, what is stale, upserts, and the statistics of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fingerprints(files: DataFrame, path: str, text: str) -> DataFrame:
    """path, content_md5."""
    return files.select(F.col(path).alias("path"), F.md5(text).alias("content_md5"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """path, content_md5, change (new or modified) of fingerprints that differ from those before."""
    b = before.select("path", F.col("content_md5").alias("old"))
    j = now.join(b, "path", "left").where(~F.col("old").eqNullSafe(F.col("content_md5")))
    return j.select("path", "content_md5", F.when(F.col("old").isNull(), "new").otherwise("modified").alias("change"))


def stale(existing: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Keys that exist and are gone now; none if there is nothing now, as a failed scan must not empty an index."""
    any_now = now.agg((F.count("*") > 0).alias("any"))
    return existing.join(now, key, "left_anti").crossJoin(F.broadcast(any_now)).where("any").select(key)  # one row


def upsert(base: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """base with new rows put in by key; of several new rows for a key the one of the highest order wins."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    last = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return base.join(last, key, "left_anti").unionByName(last)


def index_run(files: DataFrame, state: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An index brought in step with files (path, text): its chunks from now on, the state from now on, and the run's statistics.

    state (path, content_md5) and existing (chunk_id, source, ...) are what the last run left. Files with critical issues
    are not indexed. Only changed files are cut, and their chunks replace those they had; chunks of files that are gone
    or rejected go. Of equal chunk ids one row stays. If there are no files at all, the index stays as it is. The caller
    writes the chunks first and the state last, so that a run that fails is made again.
    """
    from corpusloom.operators.chunking import heading_chunks
    from corpusloom.operators.quality import CRITICAL, content_issues, gate

    f = files.select(F.col("path").alias("file"), "text")
    kept, why = gate(f, content_issues(f, rules=CRITICAL))
    now = fingerprints(kept, "file", "text")
    diff = changed(now, state)
    new = heading_chunks(kept.join(diff.select(F.col("path").alias("file")), "file", "left_semi"), "file", "text").dropDuplicates(["chunk_id"])
    any_now = files.agg((F.count("*") > 0).alias("any"))
    same = now.join(diff.select("path"), "path", "left_anti").select(F.col("path").alias("source"), F.lit(True).alias("same"))
    stays = existing.join(same, "source", "left").crossJoin(F.broadcast(any_now)).where("same OR NOT any")  # one row
    chunks = stays.select(new.columns).join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)
    after = state.crossJoin(F.broadcast(any_now)).where("NOT any").select("path", "content_md5").unionByName(now)
    stats = run_statistics(fingerprints(f, "file", "text"), state, why.select(F.col("file").alias("path")))
    return chunks, after, stats


def run_statistics(now: DataFrame, before: DataFrame, rejected: DataFrame) -> DataFrame:
    """files_seen, files_new, files_modified, files_unchanged, files_rejected, files_removed."""
    n = now.select("path", "content_md5").join(rejected.select("path", F.lit(True).alias("rejected")), "path", "left")
    j = n.join(before.select("path", F.col("content_md5").alias("old")), "path", "full_outer")
    is_now, is_old, no = F.col("content_md5").isNotNull(), F.col("old").isNotNull(), F.coalesce("rejected", F.lit(False))
    return j.agg(
        F.count_if(is_now).alias("files_seen"), F.count_if(is_now & ~no & ~is_old).alias("files_new"), F.count_if(is_now & ~no & is_old & (F.col("old") != F.col("content_md5"))).alias("files_modified"),
        F.count_if(is_now & ~no & (F.col("old") == F.col("content_md5"))).alias("files_unchanged"), F.count_if(is_now & no).alias("files_rejected"), F.count_if(~is_now & is_old).alias("files_removed"),
    )
