"""Whitening of embeddings with Spark MLlib's block matrices."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvara.storage import staged

#: Rows and columns of a block; blocks of a product's long side that one task multiplies.
BLOCK_ROWS, BLOCK_COLUMNS, BLOCKS_A_TASK = 1024, 1024, 4
#: Directions with less than this share of the variance are taken to have none.
NO_VARIANCE = 1e-12
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vectors: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, x): entries as floor(scale * c) + shift.

    Null vectors and those with null or non-finite entries take no part, nor do those with entries of 2^56 or more, whose
    x wouldn't fit a long.
    """
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**56)))
    rows = vectors.where(F.col("embedding").isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda c: F.floor(scale * c.cast("double")).cast("long") + shift).alias("x"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` staged with a gapless ``index`` from 0, without a shuffle: counts by task give each task's first."""
    held = staged(rows.withColumn("__id", F.monotonically_increasing_id()).select("*", F.shiftright("__id", 33).alias("__task"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")).drop("__id"))
    counts = held.groupBy("__task").agg(F.count("*").alias("m"))
    first = counts.select("__task", (F.sum("m").over(Window.orderBy("__task")) - F.col("m")).alias("__first"))  # a row a task
    return held.join(F.broadcast(first), "__task").withColumn("index", F.col("__first") + F.col("__at")).drop("__task", "__at", "__first")


def blocks(rows: DataFrame, values: Column, n: int, d: int) -> BlockMatrix:
    """Rows (index, an array of doubles) as a block matrix, in the JVM from end to end."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(values).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(BLOCK_ROWS, BLOCK_COLUMNS)


def product(a: BlockMatrix, b: BlockMatrix) -> BlockMatrix:
    """a * b, its middle dimension split over tasks: one block of the result would else meet all blocks in one task."""
    splits = max(1, -(-a.numColBlocks // BLOCKS_A_TASK))
    return BlockMatrix(a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits), a.rowsPerBlock, b.colsPerBlock)


def scatter(a: BlockMatrix) -> np.ndarray:
    """The transpose of ``a`` times ``a``, as a local matrix of columns by columns."""
    return product(a.transpose(), a).toLocalMatrix().toArray()


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """Rows (vec_id, x: array of long) whitened: a row for each vector and component, see ``WHITENED``.

    Components are the unit eigenvectors of the covariance (divisor n) of all rows, by falling eigenvalue from 1.
    ``whitened`` is the row less the mean, projected on the component, over the root of its eigenvalue; ``explained`` the
    eigenvalue's share; ``deviation`` the sum over dimensions of (n * x - sum)^2, null where it doesn't fit a long;
    ``identity_error`` the largest absolute entry of whitened's covariance less the identity.

    Rows become blocks, transposed blocks times blocks the scatter matrix; only that matrix of dimension by dimension is
    solved on the driver, and blocks times the whitening matrix are the projections. Directions without variance give no
    rows: equal vectors, a single one or an empty table give none. Vectors are as long as most are (of equals the shorter);
    others take no part. Null and repeated ids are rows like any other. n and the sums count all rows that take part.
    """
    spark = vectors.sparkSession
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), "d").first()
    n, d = (most.n, most.d) if most else (0, 0)
    nothing = spark.createDataFrame([], WHITENED)
    if not n or not d:
        return nothing
    rows = staged(numbered(vectors.where(F.size("x") == d).select("vec_id", "x")))
    sums, means = rows.agg(F.array(*[F.try_sum(F.col("x")[i]) for i in range(d)]), F.array(*[F.avg(F.col("x")[i]) for i in range(d)])).first()  # a number a dimension
    off = F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in sums]), lambda x, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), x), s))
    near = F.zip_with("x", F.array(*map(F.lit, means)), lambda x, mean: x - mean)
    squares = F.aggregate("off", F.lit(0).cast("long"), lambda total, x: F.try_add(total, F.try_multiply(x, x)))
    centred = F.zip_with("off", "near", lambda o, c: F.coalesce(o / n, c))
    rows = staged(rows.select("index", "vec_id", off.alias("off"), near.alias("near")).select("index", "vec_id", squares.alias("deviation"), centred.alias("centred")))

    a = blocks(rows, F.col("centred"), n, d)
    values, directions = np.linalg.eigh(scatter(a) / n)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(components, int((values > values.clip(0).sum() * NO_VARIANCE).sum()))
    if not k:
        return nothing
    w = directions[:, :k] / np.sqrt(values[:k])
    pieces = [((i, 0), DenseMatrix(len(p), k, p.ravel(order="F"))) for i, p in enumerate(w[j : j + BLOCK_COLUMNS] for j in range(0, d, BLOCK_COLUMNS))]
    projected = product(a, BlockMatrix(spark.sparkContext.parallelize(pieces, len(pieces)), BLOCK_COLUMNS, k, d, k)).toIndexedRowMatrix()
    z = staged(callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model).select("index", vector_to_array("vector").alias("z")))
    error = float(np.abs(scatter(blocks(z, F.col("z"), n, k)) / n - np.eye(k)).max())
    share = F.array(*[F.lit(float(v)) for v in values[:k] / values.clip(0).sum()])
    long = rows.join(z, "index").select("vec_id", "deviation", F.posexplode("z").alias("i", "whitened"))
    return long.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """All vectors on their first 32 components."""
    return whiten(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), 32)
