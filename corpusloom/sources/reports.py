"""Results that are kept by what they were made of, and read again until that changes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.store import stamp


def kept_report(spark: SparkSession, base: str, name: str, inputs: list[str], make: Callable[[], DataFrame], parameters: str = "", force: bool = False) -> DataFrame:
    """The report of that name: read if it was made before of inputs (paths) in the state that they are in, else made and written.

    The state is that of the files' number, paths, sizes and times, which are listed and not read. parameters: what else
    the report depends on. force: it is made anew; the newest one counts. A report is whole or not there.
    """
    said = "\0".join([name, parameters, *[f"{p}={stamp(spark, p)}" for p in inputs]])
    path = f"{base}/{name}/{hashlib.sha256(said.encode()).hexdigest()[:24]}"
    number = _newest(spark, path)
    if number is None or force:
        number = 0 if number is None else number + 1
        make().write.mode("error").parquet(f"{path}/made={number}/report")
        spark.createDataFrame([(number,)], "number int").coalesce(1).write.mode("append").parquet(f"{path}/whole")
    return spark.read.parquet(f"{path}/made={number}/report")


def _newest(spark: SparkSession, path: str) -> int | None:
    try:
        return spark.read.schema("number int").parquet(f"{path}/whole").agg(F.max("number")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
