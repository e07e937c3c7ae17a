"""Embedding near-dedup: sign hashes of random hyperplanes, exact cosines, connected components.

Equal vectors are one class with a count. Each class gets a code of signs in each of several tables; the number of
bits follows the number of classes, so that buckets hold about `load` of them at any size, and the number of tables
follows from the bits and the recall asked for at the threshold itself. Each bucket is compared in tiles of bounded
size, with cosines in double precision. A pair that shares several buckets counts in the first table in which its
codes agree, so links are counted once without ever being listed.

Null vectors, and those that are empty, zero or hold null or non-finite components, link with nothing; nor do
vectors without id, which keep a null component. Vectors of different lengths don't link. Each row is a vector of its
own: rows that repeat an id with other vectors have the links and the component of their own vector, and the id that
names a component is the least of its rows. Ties in cosine can't arise, as every pair at the threshold links. Other
columns, whatever their names, are neither read nor kept. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small_batches, written
from corpusloom.llm.components import components
from corpusloom.llm.tiles import links, tiled

THRESHOLD, RECALL, LOAD, SIDE = 0.95, 0.9995, 192, 1024


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL, load: int = LOAD) -> tuple[int, int]:
    """Bits a code and number of tables for n vectors."""
    bits = min(30, max(1, math.ceil(math.log2(max(n, 2) / load))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def classes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """cls (digest of the vector), least (id), n, vec: once for each different vector that can link."""
    v = vectors[vec_col]
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    d = vectors.select(vectors[id_col].alias("least"), F.transform(v, lambda x: x.cast("double") + F.lit(0.0)).alias("vec")).where(fine & vectors[id_col].isNotNull())
    d = d.withColumn("cls", F.unhex(F.md5(F.array_join(F.col("vec").cast("array<string>"), ","))))
    return d.groupBy("cls").agg(F.min("least").alias("least"), F.count("*").alias("n"), F.first("vec").alias("vec"))  # first: all are equal


def _units(packed: list[bytes], kind: str) -> np.ndarray:
    """Packed vectors of one length at length one, in double precision."""
    v = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(float)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _codes(units: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """The code of each vector in each table: the signs of its products with random planes, which depend on the seed and the length alone."""
    planes = np.random.default_rng([seed, units.shape[1]]).standard_normal((units.shape[1], bits * tables))
    signs = (units @ planes > 0).reshape(len(units), tables, bits)
    return (signs << np.arange(bits)).sum(axis=2).astype(np.int32)


def packed(c: DataFrame, kind: str) -> DataFrame:
    """node, n, vec (as bytes) and dim of classes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [np.array(x, kind).tobytes() for x in batch["vec"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["n"], pa.array(v, pa.binary()), pa.array([len(x) // np.dtype(kind).itemsize for x in v], pa.int32())], names=["node", "n", "vec", "dim"])

    return c.select("node", "n", "vec").mapInArrow(work, "node long, n long, vec binary, dim int")


def hashed(vectors: DataFrame, kind: str, bits: int, tables: int, seed: int) -> DataFrame:
    """node, dim, tab, code of packed vectors: small rows, one for each table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["dim"].to_numpy()
            for dim in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                codes = _codes(_units(part["vec"].to_pylist(), kind), bits, tables, seed)
                each = np.repeat(np.arange(len(part)), tables)
                yield pa.RecordBatch.from_arrays([part["node"].take(pa.array(each)), pa.array(np.full(len(each), dim, np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(part))), pa.array(codes.reshape(-1))], names=["node", "dim", "tab", "code"])

    return vectors.select("node", "dim", "vec").mapInArrow(work, "node long, dim int, tab int, code int")


def _comparer(threshold: float, kind: str, bits: int, tables: int, seed: int):
    def compare(a: pd.DataFrame, b: pd.DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
        u = _units(list(a["vec"]), kind)
        v = u if b is None else _units(list(b["vec"]), kind)
        i, j = np.nonzero(u @ v.T >= threshold)
        if b is None:
            i, j = i[keep := i < j], j[keep]
        if not len(i):
            return i, j
        # of rows with links the codes of all tables: a pair counts in the first one in which it agrees
        tab = a["tab"].iloc[0]
        of = lambda x, at: (np.unique(at, return_inverse=True)[1], _codes(x[np.unique(at)], bits, tables, seed))
        (p, cu), (q, cv) = of(u, i), of(v, j)
        new = (cu[p, :tab] != cv[q, :tab]).all(axis=1)
        return i[new], j[new]

    return compare


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 11) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept, n_copies (other rows with the same vector)."""
    v = vectors[vec_col]
    # a class is a node of its own, by its place in the written table: ids may repeat with other vectors
    c = written(classes(small_batches(vectors), id_col, vec_col), "vectors")
    c = written(c.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bits, tables = plan(c.count(), threshold, recall)
    # single precision as it comes loses nothing, and products are taken in double precision
    kind = "f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "f8"
    v4 = written(packed(c, kind), "packed")
    keys = ["tab", "dim", "code"]
    # buckets are sized and cut by small rows; each vector then goes once to each tile that it is in
    dealt = tiled(hashed(v4, kind, bits, tables, seed), keys, "node", SIDE).hint("merge").join(v4.select("node", "n", "vec"), "node")
    found = written(links(dealt, keys, "node", "n", _comparer(threshold, kind, bits, tables, seed), "long"), "found")
    near = found.groupBy("node").agg(F.sum("n_links").alias("near"))
    parts = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "edges")
    each = c.select("cls", "node", "least", "n").join(near, "node", "left").join(parts, "node", "left")
    each = written(each.select("cls", "n", "least", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("component", "node").alias("part")), "parts")
    named = written(each.groupBy("part").agg(F.min("least").alias("component")), "named")  # written, so that the join is split at a large component
    per = each.join(named.hint("merge"), "part").select("cls", "n", "near", "component")
    digest = F.unhex(F.md5(F.array_join(F.transform(v, lambda x: x.cast("double") + F.lit(0.0)).cast("array<string>"), ",")))
    out = vectors.select(vectors[id_col].alias("vec_id"), F.when(vectors[id_col].isNotNull(), digest).alias("cls")).join(written(per, "per"), "cls", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("near") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"), F.coalesce(F.col("n") - 1, F.lit(0)).cast("long").alias("n_copies"))


def oracle(threshold: float = THRESHOLD) -> str:
    return f"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS i, vec_id, embedding FROM embeddings),
v AS (SELECT i, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM e
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.i AS a, b.i AS b, a.e = b.e AS same FROM v a JOIN v b ON a.i <> b.i AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
k AS (SELECT a, min(vec_id) AS c FROM r JOIN v ON v.i = r.b GROUP BY a), n AS (SELECT a, count(*) AS n, count(*) FILTER (same) AS m FROM p GROUP BY a),
s AS (SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(k.c, e.vec_id), e.vec_id) AS component_id, coalesce(n.m, 0) AS n_copies FROM e LEFT JOIN k ON k.a = e.i LEFT JOIN n ON n.a = e.i)
SELECT vec_id, n_links, component_id, component_id IS NOT DISTINCT FROM vec_id AS kept, n_copies FROM s"""
