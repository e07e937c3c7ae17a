"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup side up to this many bytes, as measured, is sent to every executor; a larger one is shuffled.
BROADCAST_BYTES = 16 << 20
#: Batches that go to Python and back hold so many bytes at most, whatever the length of texts.
ARROW_BYTES = 8 << 20


def doc_key(id_col: Column, text: Column) -> Column:
    """16 bytes that stand for a document: its id (null differs from any value) with its whole text.

    Rows that repeat both id and text share a key, and so share every result.
    """
    said = F.when(id_col.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), id_col.cast("string")))
    return F.unhex(F.md5(F.concat(said, F.lit("\x00"), text)))


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: bool = False) -> DataFrame:
    """`doc` (see doc_key), `id`, `text` (null: empty) and, with keep, `row`: all columns of the input."""
    text = F.coalesce(docs[text_col], F.lit(""))
    own = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if keep else []
    return docs.select(doc_key(docs[id_col], text).alias("doc"), docs[id_col].alias("id"), text.alias("text"), *own)


def sized(df: DataFrame, width: Column) -> tuple[DataFrame, bool]:
    """df, and whether the bytes of its rows, summed over all of them, are within BROADCAST_BYTES."""
    return df, (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES


def small_side(df: DataFrame, width: Column) -> DataFrame:
    """df, marked for broadcast if it is small enough."""
    df, small = sized(df, width)
    return F.broadcast(df) if small else df


def small_batches(df: DataFrame) -> DataFrame:
    """df; from here on its session hands rows to Python in batches of ARROW_BYTES."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return df


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a folder of this machine serves, for local masters only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/corpusloom-shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, compression: str | None = None) -> DataFrame:
    """df as written to the shared folder and read again: later steps reread it and don't make it anew."""
    path = f"{shared_dir(df.sparkSession)}-{what}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
