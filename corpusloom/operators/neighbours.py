"""Approximate nearest vectors: an inverted file of coarse cells that a search opens only in part.

Centres are what a few rounds of k-means on a bounded sample end with; every row of the table then goes to its nearest
centre's cell. Cells are the folders of a partitioned table, so that a search names the cells that it wants and Spark
reads no others' files. Each query opens the cells whose centres are nearest to it, cosines of what stands there are
exact, and the best k win. How many cells must be opened is measured: `probes_for` takes a bounded sample of rows as queries,
finds their exact neighbours and in which of a query's cells, by nearness, these stand. With all cells the search is exact.

The sample (SAMPLE rows by hash of their ids) fits the centres only: all rows are indexed and can be found. A
cell's rows are dealt into parts of about PART, and its queries likewise, so that a task compares a bounded part with a
bounded part, however many rows share a vector or an id. Null, empty, zero and non-finite vectors, and those of another length than
most, are left out; repeated rows are found each. Equal cosines (to six digits) rank by id. An index of no rows finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.search import top
from corpusloom.sources.store import written

SAMPLE, ROUNDS = 16_384, 12
#: Rows that a cell should hold, cells at most, and rows and queries of a part.
CELL_ROWS, MOST_CELLS, PART, QUERY_PART = 256, 4096, 4096, 1024
#: Queries that `probes_for` measures with.
MEASURED = 128


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)


def centres(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """`cells` directions at most, by k-means with cosines; a cell that loses all its vectors takes the one worst off."""
    x = _units(np.unique(sample, axis=0))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        like = x @ c.T
        near, best = like.argmax(axis=1), like.max(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        for k in np.flatnonzero(np.bincount(near, minlength=len(c)) == 0):
            worst = int(best.argmin())
            total[k], best[worst] = x[worst], 1.0
        c = _units(total)
    return c


@dataclass
class InvertedFile:
    """Below path: rows (cell, part, id, vec) by cell, and the cells with their centres and numbers of parts, MOST_CELLS at most."""

    path: str
    centres: np.ndarray
    cells: DataFrame
    rows: DataFrame

    @property
    def id_type(self) -> str:
        return self.rows.schema["id"].dataType.simpleString()


def _fine(vectors: DataFrame) -> DataFrame:
    v = F.transform("vec", lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    d = vectors.withColumn("vec", v).where(F.coalesce(ok, F.lit(False)))
    size = d.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return d.where(F.size("vec") == (size["dim"] if size else 0))


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.asarray(vectors.flatten()).reshape(len(vectors), -1)


def _near(c: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each vector, the nearest first."""
    like = _units(v) @ c.T
    n = min(n, len(c))
    some = np.argpartition(-like, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(like, some, axis=1), axis=1, kind="stable"), axis=1)


def build(vectors: DataFrame, path: str, cells: int | None = None) -> InvertedFile:
    """Writes the inverted file of vectors (id, vec) below path. cells: by default one for CELL_ROWS rows, MOST_CELLS at most."""
    spark = vectors.sparkSession
    d = _fine(vectors.select("id", "vec"))
    n = d.count()
    share = int(min(1.0, 2 * SAMPLE / max(n, 1)) * (1 << 30))
    at = F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30))
    few = d.select("vec", at.alias("at")).where(F.col("at") < share).orderBy("at").limit(SAMPLE)
    found = few.select("vec").toArrow()["vec"].combine_chunks()  # SAMPLE rows at most
    c = centres(_matrix(found), cells or max(1, min(MOST_CELLS, math.ceil(n / CELL_ROWS)))) if len(found) else np.zeros((0, 1))
    kind = d.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cell = _near(c, _matrix(batch["vec"]), 1)[:, 0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["id"], batch["vec"], pa.array(cell)], names=["id", "vec", "cell"])

    placed = written(d.mapInArrow(work, f"id {kind}, vec array<double>, cell int"), "placed")
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
    rows = [(k, c[k].tolist(), n, -(-n // PART)) for k, n in sorted(sizes.items())]
    table = spark.createDataFrame(rows, "cell int, centre array<double>, n long, parts long")
    table.coalesce(1).write.mode("error").parquet(f"{path}/cells")
    # by a row's place in the written files, not by its contents: no value fills a part
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts")).cast("int")
    dealt = placed.join(F.broadcast(table.select("cell", "parts")), "cell").withColumn("part", part).drop("parts")
    dealt.repartition("cell", "part").sortWithinPartitions("cell").write.partitionBy("cell").mode("error").parquet(f"{path}/rows")
    return opened(spark, path, f"part int, id {kind}, vec array<double>, cell int")


def opened(spark: SparkSession, path: str, schema: str | None = None) -> InvertedFile:
    """An inverted file that was built before. schema: of its rows, for one that may have none."""
    cells = spark.read.schema("cell int, centre array<double>, n long, parts long").parquet(f"{path}/cells")
    found = cells.orderBy("cell").select("centre").toArrow()["centre"].combine_chunks()
    rows = spark.read.schema(schema).parquet(f"{path}/rows") if schema else spark.read.parquet(f"{path}/rows")
    return InvertedFile(path, _matrix(found) if len(found) else np.zeros((0, 1)), cells, rows)


def _numbers(index: InvertedFile) -> np.ndarray:
    return np.array([r["cell"] for r in index.cells.orderBy("cell").select("cell").collect()], np.int32)


def probed(index: InvertedFile, queries: DataFrame, probes: int | None) -> DataFrame:
    """qid, q, cell, nth: the cells that each query (qid, vec) opens, the nearest is the first. probes: of so many; None: all."""
    c, numbers = index.centres, _numbers(index)
    kind = queries.schema["qid"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near = _near(c, _matrix(batch["vec"]), probes or len(c))
                each = pa.array(np.repeat(np.arange(len(batch)), near.shape[1]))
                nth = np.tile(np.arange(1, near.shape[1] + 1, dtype=np.int32), len(batch))
                yield pa.RecordBatch.from_arrays([batch["qid"].take(each), batch["vec"].take(each), pa.array(numbers[near.reshape(-1)]), pa.array(nth)], names=["qid", "q", "cell", "nth"])

    q = _fine(queries.select("qid", "vec")).where(F.size("vec") == c.shape[1])
    return q.mapInArrow(work, f"qid {kind}, q array<double>, cell int, nth int")


def nearest(index: InvertedFile, queries: DataFrame, k: int, probes: int | None = 8, others: bool = False) -> DataFrame:
    """qid, id, similarity, rank, nth (the query's nth cell): the k nearest to each query (qid, vec) in the cells that it opens. others: rows of the query's own id don't count."""
    spark = queries.sparkSession
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id {index.id_type}, similarity double, nth int"
    if not len(index.centres):
        return top(spark.createDataFrame([], schema), k, "similarity")
    asked = written(probed(index, queries, probes), "asked")
    cells = asked.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / QUERY_PART).alias("q_parts"))
    cells = written(cells.join(F.broadcast(index.cells.select("cell", "parts")), "cell"), "opened")  # MOST_CELLS rows at most
    wanted = [r[0] for r in cells.select("cell").collect()]
    spread = lambda d, own, other: d.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other + "s").cast("int") - 1))).drop("parts", "q_parts")
    rows = index.rows.where(F.col("cell").isin(wanted)).join(F.broadcast(cells), "cell")  # other cells' folders aren't read
    own_part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("q_parts")).cast("int")
    left = spread(rows, "part", "q_part")
    right = spread(asked.join(F.broadcast(cells), "cell").withColumn("q_part", own_part), "q_part", "part")

    def compare(found: pa.Table, queries: pa.Table) -> pa.Table:
        kinds = pa.schema([("qid", queries.schema.field("qid").type), ("id", found.schema.field("id").type), ("similarity", pa.float64()), ("nth", pa.int32())])
        if not len(found) or not len(queries):
            return kinds.empty_table()
        found = found.sort_by("id")
        v, q = _units(_matrix(found["vec"].combine_chunks())), _units(_matrix(queries["q"].combine_chunks()))
        like = np.floor(q @ v.T * 1e6 + 0.5) / 1e6
        ids, qids = found["id"].combine_chunks(), queries["qid"].combine_chunks()
        if others:
            for i, own in enumerate(qids):
                like[i, pc.equal(ids, pa.scalar(own.as_py(), ids.type)).fill_null(False).to_numpy(zero_copy_only=False)] = -2
        at = np.argsort(-like, axis=1, kind="stable")[:, :k]  # equal ones stay in order of ids
        value = np.take_along_axis(like, at, axis=1)
        row, col = np.nonzero(value > -2)
        return pa.Table.from_arrays([qids.take(pa.array(row)), ids.take(pa.array(at[row, col])), pa.array(value[row, col]), queries["nth"].combine_chunks().take(pa.array(row))], schema=kinds)

    keys = ("cell", "part", "q_part")
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, schema)
    return top(hits, k, "similarity")


def probes_for(index: InvertedFile, k: int, recall: float = 0.95, queries: int = MEASURED) -> int:
    """How many cells a query must open for the k nearest to be found with that recall, measured on a sample of indexed rows."""
    total = len(index.centres)
    if total < 2:
        return total
    rows = index.rows.select("id", "vec")
    n = rows.count()
    at = F.pmod(F.xxhash64("vec", F.lit(9)), F.lit(1 << 30))
    some = rows.withColumn("at", at).where(F.col("at") < int(min(1.0, 4 * queries / n) * (1 << 30))).orderBy("at", "id").limit(queries).select(F.monotonically_increasing_id().alias("qid"), "vec")
    found = nearest(index, written(some, "measured"), k + 1, None)  # the row itself is the first
    nth = np.sort(np.array([r["nth"] for r in found.where("rank > 1").select("nth").collect()]))  # k rows a query
    return int(nth[min(len(nth) - 1, math.ceil(recall * len(nth)))]) if len(nth) else total


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n_queries, recall: the share of exact hits (qid, id) that are found, over queries with any."""
    j = exact.select("qid", "id").distinct().join(found.select("qid", "id", F.lit(1).alias("hit")).distinct(), ["qid", "id"], "left")
    return j.agg(F.count_distinct("qid").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
