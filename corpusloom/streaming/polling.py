"""Folders that are polled: a listing tells what is new, changed and gone, and only what changed is opened.

A poll lists the files with their lengths and times, which reads no contents, and compares that with the listing that the last
poll left. Files that differ are opened and go to the kept index; files that are no more in the listing lose their chunks, without help from the caller. The
new listing is written behind the index's version, so that a poll that fails is made again from where it began.

As a stream, polls are the micro-batches of a clock (`every`); a push calls `poll` once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corpusloom.operators import maintained
from corpusloom.sources.formats import to_markdown
from corpusloom.sources.store import written

#: Fixed value: what a file must end with to be read.
EXTENSIONS = ["md", "txt", "pdf", "html", "htm", "rst", "docx", "json", "yaml", "yml", "csv"]
LISTING = "path string, length long, modified timestamp"
#: So many changed files are opened by name; more are found by a join over the whole folder.
NAMED = 10_000


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path (below folder), length, modified of its files with a known ending, hidden ones left out. Files are listed, not read."""
    root = folder.rstrip("/") + "/"
    try:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LISTING)
    at = F.expr(f"substr(path, locate('{root.replace(chr(39), chr(39) * 2)}', path) + {len(root)})")
    f = f.select(at.alias("path"), "length", F.col("modificationTime").alias("modified"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return f.where(ext.isin(EXTENSIONS) & ~F.exists(F.split("path", "/"), lambda x: x.startswith(".")))


def _last(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    try:
        rows = spark.read.schema(f"{LISTING}, poll int").parquet(f"{path}/listings")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, spark.createDataFrame([], LISTING)
    last = rows.agg(F.coalesce(F.max("poll"), F.lit(0))).first()[0]
    return last, rows.where(F.col("poll") == last).drop("poll")


def opened(spark: SparkSession, folder: str, changed: DataFrame) -> DataFrame:
    """path, text of the changed files (path) below folder."""
    root = folder.rstrip("/") + "/"
    few = [r["path"] for r in changed.select("path").limit(NAMED + 1).collect()]
    if not few:
        return spark.createDataFrame([], "path string, text string")
    reader = spark.read.format("binaryFile")
    raw = reader.load([root + p for p in few]) if len(few) <= NAMED else reader.option("recursiveFileLookup", "true").load(folder)
    at = F.expr(f"substr(path, locate('{root.replace(chr(39), chr(39) * 2)}', path) + {len(root)})")
    files = raw.select(at.alias("path"), "content").join(changed.select("path"), "path", "left_semi")
    return to_markdown(files)


def poll(spark: SparkSession, folder: str, path: str, model: maintained.Model = maintained.HASHED, force: bool = False) -> DataFrame:
    """Brings the index below path in step with a folder and returns the run's statistics; see maintained.update."""
    n, before = _last(spark, path)
    now = written(listing(spark, folder), "listing")
    changed = now if force else now.join(before, ["path", "length", "modified"], "left_anti")
    texts = written(opened(spark, folder, written(changed, "changed")), "texts")
    stats = written(maintained.update(texts, path, model, force, present=now.select("path")), "stats")
    if now.take(1):
        now.write.mode("error").parquet(f"{path}/listings/poll={n + 1}")
    return stats


def every(spark: SparkSession, folder: str, path: str, seconds: int = 300, model: maintained.Model = maintained.HASHED) -> DataStreamWriter:
    """Polls a folder every so many seconds for as long as the query runs. The clock is Spark's rate source: its rows say when, and nothing else."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda rows, number: poll(spark, folder, path, model)).trigger(processingTime=f"{seconds} seconds")
