"""Embedding whitening with distributed block matrices.

Vectors become whole numbers x = floor(256 * c). The covariance is that of each distinct x
once (the fit list). Rows get dense numbers; rows of the fit list less their mean become a
``BlockMatrix`` A, whose other rows are zero; A' A is the scatter; its eigenvectors are
found on the driver (a matrix of dimension by dimension entries, at most ``DIMENSIONS``
wide); a second ``BlockMatrix`` of all rows, multiplied by the whitening matrix, projects
them.

Sums are exact: they are those of whole numbers. The only things that reach the driver are
one sum for each dimension, the scatter, and what ``BlockMatrix`` keeps of itself there, two
numbers for each block (of up to 8 MB). Copies of a vector are merged where they lie before
they are shuffled.

Odd input: rows whose vector is null or has a null or non-finite entry are dropped. A vector
shorter than the longest has zeros where it ends; an empty one is all zeros. Components
without variance can't be scaled to one and are left out, so a table whose vectors are all
alike gives no rows, as an empty one does. A deviation beyond 64 bits is null. Repeated rows
and null vec_ids are kept; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix, Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .sharding import global_numbers

#: Widest vectors: a matrix of this width is 134 MB.
DIMENSIONS = 4096
#: Entries of a block, least and most; blocks grow with the table between the two.
BLOCK = (1 << 16, 1 << 20)
#: Blocks that one task multiplies at a time.
BLOCKS_EACH = 8


def whole_numbers(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole and finite; x as array<bigint>."""
    entries = F.col(vector).cast("array<double>")
    slim = embeddings.select(F.col(key).cast("long").alias("vec_id"), entries.alias("c"))
    odd = F.exists("c", lambda v: v.isNull() | F.isnan(v) | v.isin(float("inf"), float("-inf")))
    return slim.where(F.col("c").isNotNull() & ~odd).select("vec_id", F.transform("c", lambda v: F.floor(v * 256.0)).alias("x"))


def block_matrix(rows: DataFrame, entries: Column, n: int, width: int) -> BlockMatrix:
    """The matrix with ``entries`` (array<double>) in row ``row_number`` of n."""
    indexed = MLUtils.convertVectorColumnsFromML(rows.select("row_number", array_to_vector(entries).alias("v")), "v")
    high = max(16, min(BLOCK[1], max(BLOCK[0], n * width // 512)) // width)
    return IndexedRowMatrix(indexed, n, width).toBlockMatrix(high, width)


def scatter(a: BlockMatrix) -> np.ndarray:
    """A' A. The rows that are summed over are split among tasks: the Python method has no
    argument for that, the Scala one that it calls has."""
    left = a.transpose()
    splits = max(1, -(-a.numRows() // (a.rowsPerBlock * BLOCKS_EACH)))
    product = left._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of ``v`` by falling eigenvalue, at most
    ``most`` and only those with variance; the largest entry of a vector is positive."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    keep = e > len(v) * np.finfo(float).eps * max(e[0], 0)
    e, u = e[keep], u[:, keep]
    return e, u * np.where(np.take_along_axis(u, np.abs(u).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)


def whiten(embeddings: DataFrame, most: int = 4, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each
    kept row and component up to ``most``."""
    spark = embeddings.sparkSession
    # a number for each row, fixed once written, so that equal rows are not in one bucket
    slim = materialize(whole_numbers(embeddings, vector, key).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = slim.agg(F.count("x").alias("rows"), F.max(F.size("x")).alias("width")).first()
    width = sizes.width or 0
    if width > DIMENSIONS:
        raise ValueError(f"vectors have {width} entries; at most {DIMENSIONS} are allowed")
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not width:
        discard(slim)
        return spark.createDataFrame([], out)
    full = F.when(F.size("x") < width, F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))).otherwise(F.col("x"))
    rows = materialize(global_numbers(slim.select("vec_id", "row", full.alias("x")), sizes.rows, ["row"]).drop("row"), "numbered")
    discard(slim)
    fit = materialize(rows.groupBy("x").agg(F.min("row_number").alias("row_number")), "fit-list")
    n = fit.count()
    sums = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.max(F.abs("v")).alias("top")).orderBy("at").collect()

    # n * x - S in whole numbers of 64 bits where they are known to do, else of 38 digits
    bound = sum((n * r.top + abs(int(r.s))) ** 2 for r in sums)
    kind = "long" if bound < 1 << 62 else "decimal(38,0)"
    whole = F.array(*[F.lit(int(r.s)).cast(kind) for r in sums])
    apart = F.zip_with("x", whole, lambda v, s: (v.cast(kind) * F.lit(n).cast("long") - s).cast(kind))
    squares = F.aggregate(apart, F.lit(0).cast(kind), lambda t, v: (t + v * v).cast(kind))
    deviation = squares if kind == "long" else squares.try_cast("long")
    centred = F.transform(apart, lambda v: v.cast("double") / n)

    v = scatter(block_matrix(fit, centred, sizes.rows, width)) / n
    e, u = components(v, most)
    if not len(e):
        return spark.createDataFrame([], out)
    every = block_matrix(rows, centred, sizes.rows, width)
    whitening = DenseMatrix(width, len(e), (u / np.sqrt(e)).ravel(order="F").tolist())
    matrix = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(width, len(e), whitening.values))], 1), every.colsPerBlock, len(e), width, len(e))
    projected = every.multiply(matrix).toIndexedRowMatrix().rows.map(lambda r: (int(r.index), r.vector.toArray().tolist()))
    y = materialize(projected.toDF("row_number long, y array<double>"), "projected")

    identity = y.join(fit.select("row_number"), "row_number").agg(
        *[F.covar_pop(F.col("y")[i], F.col("y")[j]).alias(f"c{i}_{j}") for i in range(len(e)) for j in range(i + 1)]
    ).first()
    error = max(abs(identity[f"c{i}_{j}"] - (i == j)) for i in range(len(e)) for j in range(i + 1))
    share = F.array(*[F.lit(float(x)) for x in e / math.fsum(np.diag(v))])
    joined = rows.select("row_number", "vec_id", deviation.alias("deviation")).join(y, "row_number")
    return joined.select("vec_id", "deviation", F.posexplode("y").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error")
    )
