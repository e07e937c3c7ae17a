"""Embedding whitening with distributed block matrices.

Each entry c becomes the whole number x = floor(64 * c) + 1000000. Sums over rows are exact, so a row's centred entries
are (n * x - S) / n with a whole numerator that is exact, too. Rows get consecutive numbers and become a BlockMatrix of
centred rows; its transpose times itself, summed block by block in as many tasks as there are strips of rows, is the
scatter. Only that small square goes to the driver, where its eigenvectors are found; scaled by one over the root of
their eigenvalues they are the whitening matrix, with which the BlockMatrix is multiplied. The covariance of what
comes out is measured the same way, centred by its own means, and compared with the identity.

Left out are rows whose vector is null or empty, holds null or non-finite entries, or an entry of 2 ** 40 or more, which
has no exact sums here; and, as one matrix needs one width, those of another length than most (of equally frequent
lengths the largest counts). A component whose eigenvalue is not above 1e-12 of the largest has no deviation to divide
by: its `whitened` is null, and the identity's error is measured on the others. A squared distance beyond 64 bits is
null. Rows are independent: repeated rows and ids are projected each, null ids stay null; equal eigenvalues are numbered as the
solver gives them, either sign. Other columns, whatever their names, are neither read nor kept. No row left: no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import written

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Rows of a block, and blocks that one task multiplies.
STRIP, STRIPS = 2048, 8
LARGEST, LEAST_SHARE = float(1 << 40), 1e-12


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and x (whole numbers) of each row that is kept."""
    v = vectors[vec_col]
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST)), F.lit(False))  # NaN is above all numbers
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    d = vectors.where(fine).select(vectors[id_col].alias("vec_id"), x.alias("x"))
    width = d.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return d.where(F.size("x") == (width["width"] if width else 0))


def _numbered(d: DataFrame) -> DataFrame:
    """d and `index`: 0, 1, 2, ... in order of partitions, by the partitions' sizes, one number each on the driver."""
    d = written(d.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "rows")
    sizes = d.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first")).orderBy("part").collect()
    begin = np.concatenate([[0], np.cumsum([r["n"] for r in sizes])]).tolist()
    offsets = d.sparkSession.createDataFrame([(r["part"], int(b) - int(r["first"])) for r, b in zip(sizes, begin, strict=False)], "part int, offset long")
    return d.join(F.broadcast(offsets), "part").withColumn("index", F.col("place") + F.col("offset")).drop("part", "place", "offset")


def block_matrix(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """Rows (index, values: an array of doubles) as a matrix of n by width in strips of STRIP rows."""
    d = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("values").alias("vector")), "vector")
    return IndexedRowMatrix(d, n, width).toBlockMatrix(STRIP, width)


def scatter(m: BlockMatrix, n: int) -> np.ndarray:
    """The matrix's transpose times itself, over n: strips are multiplied in tasks of their own and summed."""
    turned = m.transpose()
    # the product has one block, so that one task would get all strips; the Python method lacks the argument that splits them
    splits = max(1, -(-n // (STRIP * STRIPS)))
    product = turned._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, turned.rowsPerBlock, m.colsPerBlock).toLocalMatrix().toArray() / n


def whitening_matrix(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a covariance: the matrix (columns: eigenvectors over their deviations), the eigenvalues' shares of the trace, which have any."""
    e, vectors = np.linalg.eigh((v + v.T) / 2)
    e, vectors = np.maximum(e[::-1][:most], 0), vectors[:, ::-1][:, :most]
    has = e > LEAST_SHARE * max(float(e[0]), 1e-300)
    return vectors * np.where(has, 1 / np.sqrt(np.where(has, e, 1)), 0), e / max(float(np.trace(v)), 1e-300), has


def _centred(d: DataFrame, column: str, width: int, n: int) -> DataFrame:
    """d with `column`, an array, less its mean over all rows, position by position."""
    means = d.agg(*[(F.sum(F.col(column)[k]) / n).alias(f"m{k}") for k in range(width)]).first()
    centre = F.array(*[F.lit(float(m)) for m in means])
    return d.withColumn(column, F.zip_with(column, centre, lambda a, b: a - b))


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Per row that is kept and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark: SparkSession = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = written(_numbered(whole_numbers(vectors, id_col, vec_col)), "numbered")
    first = rows.select(F.size("x").alias("width")).first()
    if first is None:
        return spark.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    width = first["width"]
    wide = F.transform("x", lambda x: x.cast("decimal(38,0)"))
    n, *sums = rows.select(wide.alias("w")).agg(F.count("*"), *[F.sum(F.col("w")[k]) for k in range(width)]).first()
    total = F.array(*[F.lit(int(s)).cast("decimal(38,0)") for s in sums])
    apart = F.zip_with(wide, total, lambda x, s: x.cast("decimal(20,0)") * F.lit(n).cast("decimal(18,0)") - s)
    rows = rows.withColumn("apart", apart)
    near = lambda a: F.when(F.abs(a) < 1 << 32, a.cast("decimal(19,0)"))  # noqa: E731  a larger one's square has more than 64 bits
    squared = F.aggregate(F.transform("apart", lambda a: near(a) * near(a)), F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))
    rows = written(rows.select("index", "vec_id", squared.try_cast("long").alias("deviation"), F.transform("apart", lambda a: a.cast("double") / n).alias("values")), "centred")
    m = block_matrix(rows, n, width)
    turn, share, has = whitening_matrix(scatter(m, n), most)
    k = turn.shape[1]
    w = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(width, k, turn.ravel(order="F").tolist()))], 1), width, k, width, k)
    projected = m.multiply(w).toIndexedRowMatrix().rows.map(lambda r: (int(r.index), r.vector.toArray().tolist()))
    out = written(spark.createDataFrame(projected, "index long, whitened array<double>"), "projected")
    live = int(has.sum())
    z = _centred(out, "whitened", k, n).select("index", F.slice("whitened", 1, live).alias("values")) if live else None
    error = float(np.abs(scatter(block_matrix(z, n, live), n) - np.eye(live)).max()) if live else 0.0
    shares = F.array(*[F.lit(float(s)) for s in share])
    each = rows.select("index", "vec_id", "deviation").hint("merge").join(out, "index").select("vec_id", "deviation", F.posexplode("whitened").alias("k", "w"))
    return each.select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(F.col("k") < live, F.col("w")).alias("whitened"),
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
