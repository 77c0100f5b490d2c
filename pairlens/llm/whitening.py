"""Whitening of vectors with Spark MLlib's BlockMatrix.

Entries are put on a grid (``x = floor(64 * c) + 1000000``, integers), so sums are exact. The fit list
holds each distinct grid vector once; a row takes over what its vector got, so copies weigh nothing in
the fit and are projected once. Distinct vectors are numbered, centred (an integer minus a fraction)
and become rows of a distributed BlockMatrix; its transpose multiplied by it is the scatter matrix, of
dims times dims entries, whose eigenvectors are found locally. The BlockMatrix multiplied by the
whitening matrix projects all rows, and that result's own scatter tells how far its covariance is from
the identity.

MLlib deals the blocks of a tall matrix to about the square root of the partitions it is given, and
keeps the list of block numbers on the driver. So the matrix is made in slabs of ``slab_rows`` vectors
(stored by slab, so each reads its own), whose scatters add up; a scatter's products are split over
groups of blocks (``numMidDimSplits``), so no task holds more than a few blocks of each operand.

Defined results: null vectors and vectors that hold a null, NaN or infinite entry, or one beyond
2 ** 40, are left out, as are those whose length is not the most frequent one (of several, the longest).
Components whose variance is not above the rounding error of the largest do not exist: equal vectors
alone, one vector or an empty table give no rows. An eigenvector's sign makes its entry of largest
size positive. Rows that repeat, null ids and further columns pass through; a kept column that bears
the name of an added column gets ``_`` appended.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, col, cut, shared_path

GRID, ORIGIN, LARGEST = 64.0, 1_000_000, 2.0**40
BLOCK_ROWS = 1024
SPLIT_BLOCKS = 16  # blocks of each operand in a task that multiplies
SLAB_ROWS = 1 << 25
MAX_DIMS = 4096  # of the matrix that is taken apart on the driver
_ADDED = ("n", "deviation", "component", "whitened", "explained", "identity_error")


def on_grid(vector: Column) -> Column:
    """The vector's grid entries, null where it can't be whitened (NaN compares as larger than all numbers)."""
    ok = vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    return F.when(ok, F.transform(vector, lambda c: F.floor(c.cast("double") * GRID).cast("long") + ORIGIN))


@dataclass
class Fit:
    """What was fitted: ``vectors`` (x, idx, slab), their number, sums, eigenvalues and the whitening matrix."""

    path: str
    vectors: DataFrame
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the covariance, falling
    trace: float
    matrix: np.ndarray  # dims times components
    slabs: int


def _numbered(df: DataFrame) -> DataFrame:
    """Dense numbers ``idx`` for the rows of ``df``, whatever their order: places in a partition and sizes of the earlier ones."""
    placed = cut(df.withColumn("pid", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("pid").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    before = sizes.select(F.col("pid").alias("p"), "first", (F.sum("rows").over(Window.orderBy("pid")) - F.col("rows")).alias("before"))  # a row for each partition
    return placed.join(F.broadcast(before), F.col("pid") == F.col("p")).select(*df.columns, (F.col("before") + F.col("at") - F.col("first")).alias("idx"))


def _blocks(indexed: DataFrame, vector: str, dims: int) -> BlockMatrix:
    """Rows (idx, array<double>) as blocks of a distributed matrix."""
    rows = indexed.select("idx", array_to_vector(F.col(vector)).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows, "vector")).toBlockMatrix(BLOCK_ROWS, dims)


def _scatter(blocks: BlockMatrix, rows: int, dims: int) -> np.ndarray:
    """Transpose times matrix. The product is over groups of row blocks, not all of them in one task."""
    splits = max(1, -(-rows // (BLOCK_ROWS * SPLIT_BLOCKS)))
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, dims, dims).toLocalMatrix().toArray()  # dims times dims entries


def _mean(sums: list[int], n: int) -> Column:
    """For each dimension the whole part of its mean and the remainder of the sum."""
    return F.array(*[F.struct(F.lit(s // n).cast("long").alias("whole"), F.lit(s % n).cast("long").alias("rest")) for s in sums])


def _centred(sums: list[int], n: int) -> Column:
    """Entries minus their means as doubles: an exact integer minus a fraction."""
    return F.zip_with("x", _mean(sums, n), lambda x, m: (x - m["whole"]).cast("double") - m["rest"].cast("double") / F.lit(float(n)))


def _rows(spark, matrix: BlockMatrix) -> DataFrame:
    """The rows of a BlockMatrix as (index, vector), within the JVM."""
    return callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)


def fit(grid: DataFrame, components: int = 16, slab_rows: int = SLAB_ROWS) -> Fit | None:
    """Fit on the distinct vectors ``x`` (array<bigint>, one length) of ``grid``; None if no component exists."""
    spark = grid.sparkSession
    path = shared_path(spark, "vectors")
    distinct = _numbered(grid.select("x").distinct())
    distinct.withColumn("slab", F.floor(F.col("idx") / slab_rows).cast("int")).write.partitionBy("slab").parquet(path)
    vectors = spark.read.schema("x array<bigint>, idx bigint, slab int").parquet(path)
    sums = vectors.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("pos").collect()  # a row for each dimension
    if not sums:
        return None
    dims, n, totals = len(sums), sums[0].n, [r.s for r in sums]
    if dims > MAX_DIMS:
        raise ValueError(f"vectors have {dims} dimensions; {MAX_DIMS} at most")
    slabs, scatter = -(-n // slab_rows), np.zeros((dims, dims))
    centred = vectors.select("idx", "slab", _centred(totals, n).alias("v"))
    for k in range(slabs):
        own = centred.where(F.col("slab") == k).select((F.col("idx") - k * slab_rows).alias("idx"), "v")
        scatter += _scatter(_blocks(own, "v", dims), min(slab_rows, n - k * slab_rows), dims)
    covariance = (scatter + scatter.T) / (2 * n)
    found, axes = np.linalg.eigh(covariance)
    found, axes = found[::-1], axes[:, ::-1]
    real = int((found > dims * np.finfo(float).eps * max(found[0], 0.0)).sum())
    kept = min(components, real)
    if not kept:
        return None
    axes = axes[:, :kept] * np.sign(axes[np.abs(axes[:, :kept]).argmax(axis=0), np.arange(kept)])
    return Fit(path, vectors, n, totals, found[:kept].copy(), float(np.trace(covariance)), axes / np.sqrt(found[:kept]), slabs)


def project(model: Fit, slab_rows: int = SLAB_ROWS) -> tuple[DataFrame, float]:
    """(idx, y) with the whitened entries of every distinct vector, and the largest entry of |covariance of y - identity|."""
    spark, (dims, kept) = model.vectors.sparkSession, model.matrix.shape
    turn = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(dims, kept, model.matrix.T.ravel().tolist()))], 1), dims, kept)
    centred, path = model.vectors.select("idx", "slab", _centred(model.sums, model.n).alias("v")), shared_path(spark, "whitened")
    for k in range(model.slabs):
        own = centred.where(F.col("slab") == k).select((F.col("idx") - k * slab_rows).alias("idx"), "v")
        turned = _rows(spark, _blocks(own, "v", dims).multiply(turn))
        values = MLUtils.convertVectorColumnsToML(turned, "vector").select((F.col("index") + k * slab_rows).alias("idx"), vector_to_array("vector").alias("y"))
        values.write.parquet(f"{path}/slab={k}")
    whitened = spark.read.schema("idx bigint, y array<double>, slab int").parquet(path)
    means = [r.m for r in whitened.select(F.posexplode("y")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()]  # a row for each component
    shift, scatter = F.array(*[F.lit(float(m)) for m in means]), np.zeros((kept, kept))
    for k in range(model.slabs):
        own = whitened.where(F.col("slab") == k).select((F.col("idx") - k * slab_rows).alias("idx"), F.zip_with("y", shift, lambda y, m: y - m).alias("v"))
        scatter += _scatter(_blocks(own, "v", kept), min(slab_rows, model.n - k * slab_rows), kept)
    return whitened.select("idx", "y"), float(np.abs(scatter / model.n - np.eye(kept)).max())


def deviation(x: Column, n: int, sums: list[int]) -> Column:
    """Sum over dimensions of (n * x - S) squared, exact (decimal(38, 0)); null if it has more digits."""
    total = F.zip_with(x, _mean(sums, n), lambda a, m: F.try_subtract(F.try_multiply(a - m["whole"], F.lit(n).cast("long")), m["rest"]).cast("decimal(19,0)"))
    return F.aggregate(total, F.lit(0).cast("decimal(38,0)"), lambda acc, d: F.try_add(acc, (d * d).cast("decimal(38,0)")).cast("decimal(38,0)"))


def whitened(df: DataFrame, vector: str, keep: list[str], components: int = 16, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """``keep`` columns, ``n``, ``deviation`` and a row for each component: ``component`` (from 1), ``whitened``, ``explained``, ``identity_error``."""
    spark, names = df.sparkSession, apart(keep, _ADDED)
    kept = F.struct(F.lit(0).alias("none"), *[col(c).alias(f"c{k}") for k, c in enumerate(keep)])
    grid = cut(df.select(kept.alias("kept"), on_grid(col(vector)).alias("x")).where("x is not null and size(x) > 0"))
    length = grid.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()  # one row
    grid = grid.where(F.size("x") == length.size) if length else grid
    model = fit(grid, components, slab_rows)
    if model is None:
        empty = grid.where("false").select(*[F.col(f"kept.c{k}").alias(c) for k, c in enumerate(names)])
        return empty.selectExpr("*", "0L as n", "0bd as deviation", "1 as component", "0d as whitened", "0d as explained", "0d as identity_error").withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
    turned, error = project(model, slab_rows)
    each = model.vectors.select("x", "idx", deviation(F.col("x"), model.n, model.sums).alias("deviation"))
    points = cut(each.join(turned.withColumnRenamed("idx", "i"), F.col("idx") == F.col("i")).select(F.col("x").alias("vector"), "deviation", "y"))
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    rows = grid.join(points, F.col("x") == F.col("vector")).select("kept", "deviation", F.posexplode("y").alias("place", "whitened"))
    return rows.select(
        *[F.col(f"kept.c{k}").alias(c) for k, c in enumerate(names)],
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        (F.col("place") + 1).cast("int").alias("component"),
        "whitened",
        F.get(share, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
