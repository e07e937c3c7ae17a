"""The relation graph of documents with frontmatter: entities, edges in either direction, and their history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import frontmatter, frontmatter_list, frontmatter_scalar

RELATIONS = ["replaces", "depends_on", "fixes", "implements"]


def entities(files: DataFrame) -> DataFrame:
    """path, id, type, status, superseded_at and an array for each relation, of files (path, text) with an id. Of files with one id the last path wins."""
    f = files.where(F.col("path").endswith(".md")).select("path", frontmatter(F.col("text")).alias("b"))
    cols = [frontmatter_scalar(F.col("b"), k).alias(k) for k in ("id", "type", "status", "superseded_at")] + [frontmatter_list(F.col("b"), k).alias(k) for k in RELATIONS]
    e = f.select("path", *cols).where("id IS NOT NULL")
    return e.groupBy("id").agg(F.max_by(F.struct("path", "type", "status", "superseded_at", *RELATIONS), "path").alias("e")).select("id", "e.*")


def edges(found: DataFrame) -> DataFrame:
    """src, rel, dst, resolved (whether an entity has that id)."""
    named = lambda rel: F.transform(rel, lambda x: F.struct(F.lit(rel).alias("rel"), x.alias("dst")))
    each = F.explode(F.flatten(F.array(*map(named, RELATIONS))))
    e = found.select(F.col("id").alias("src"), each.alias("e")).select("src", "e.*")
    known = found.select(F.col("id").alias("dst"), F.lit(True).alias("known"))
    return e.join(known, "dst", "left").select("src", "rel", "dst", F.coalesce("known", F.lit(False)).alias("resolved"))


def inbound(found: DataFrame) -> DataFrame:
    """id, n_inbound, sources (sorted) of entities that others point at."""
    e = edges(found).where("resolved AND src <> dst")
    return e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_inbound"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "rel", "src"))), ",").alias("sources"))


def timeline(log: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """The newest `limit` (1 to 200) log rows (key, ts, seq, ...) of each key, numbered."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq"))
    return log.withColumn("n", F.row_number().over(w)).where(F.col("n") <= min(max(limit, 1), 200))


def looked_up(asked: DataFrame, found: DataFrame, most: int = 10) -> DataFrame:
    """id, found, sample: whether an entity has the id and, if none has, the first `most` ids by path as a hint."""
    some = found.orderBy("path").limit(most).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "id"))), lambda x: x["id"]), ", ").alias("some"))
    j = asked.join(found.select("id", F.lit(True).alias("there")), "id", "left").crossJoin(F.broadcast(some))  # one row
    return j.select("id", F.coalesce("there", F.lit(False)).alias("found"), F.when(F.col("there").isNull(), F.col("some")).alias("sample"))
