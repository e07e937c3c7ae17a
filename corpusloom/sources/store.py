"""Tables that a job writes for its own later steps, and rows numbered without gathering them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, a folder of this machine serves, for local masters only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/corpusloom-shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}-{what}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as written and read again: later steps reread it, and lost executors cost no more than the current step."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamp(spark: SparkSession, path: str) -> str:
    """What tells a table's files from any others: their number, paths, sizes and times. Files are listed, not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    n, code = f.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{n}-{code}"


#: A side of a join up to this many bytes, as measured, is sent to every executor.
BROADCAST_BYTES = 16 << 20


def small_side(df: DataFrame, width: Column) -> DataFrame:
    """df, marked for broadcast if the bytes of its rows, summed over all of them, are within BROADCAST_BYTES; else written, so that Spark can split its join at a hot key."""
    return F.broadcast(df) if is_small(df, width) else written(df, "side")


def is_small(df: DataFrame, width: Column) -> bool:
    return (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with the place (from 1) of each row in the given order as column `name`.

    Rows are dealt into ranges and sorted there; only how many a range has is brought together, so that no task gets
    all rows. Equal rows are numbered in any order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = written(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = at.groupBy("_range").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("_range", "n"))).alias("sizes"))  # a row for each range
    before = F.aggregate(F.filter("sizes", lambda x: x["_range"] < F.col("_range")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return at.crossJoin(F.broadcast(sizes)).withColumn(name, before + F.col("_place") + 1).drop("_range", "_place", "sizes")  # one row
