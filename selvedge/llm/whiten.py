"""Whitening of embeddings with MLlib's distributed block matrices.

1. Rows whose vector is null or holds a null or a non-finite entry go. Entries become whole numbers,
   x = floor(scale * c) + shift; the rows are numbered from 0 without gaps and written once.
2. The rows, centred at the mean of each dimension, are indexed into a BlockMatrix. Its transpose times itself is the
   scatter, cut along the rows into as many products as there are blocks, so no task gets all rows.
3. The scatter, one entry a pair of dimensions, is brought to the driver and decomposed there. The matrix of unit
   eigenvectors over the roots of their eigenvalues, by falling eigenvalue, is a BlockMatrix again, and the blocks of
   rows times it are the whitened rows, joined back to their keys by number.

Blocks hold at least 1,024 rows and grow with the table, so that there are about 4,096 of them, up to 64 MB each: the
driver, which MLlib gives the place of every block, sees a number that the data's size hardly moves.

Defined results: a dimension that a row lacks, because its vector is shorter than the longest, counts as c = 0; a
number beyond 62 bits stops at the end of that range, and a deviation of more than 38 digits is null; a component without variance has null ``whitened`` and takes no
part in ``identity_error``. Rows with equal or null keys are rows of their own. An empty table, or one whose vectors
are all empty, gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from selvedge.session import stage

SCALE, SHIFT = 1024, 100_000
BLOCK_ROWS, BLOCKS, BLOCK_BYTES = 1_024, 4_096, 64 << 20
FLAT = 1e-12  # of the greatest eigenvalue: below it is no variance


class Fit(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray  # of the kept components, falling
    vectors: np.ndarray  # dimension x component, unit length
    trace: float

    @property
    def useful(self) -> np.ndarray:
        return self.values > FLAT * max(self.values[0], 0)


def whole_numbers(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    most = (1 << 62) - 1
    return F.transform(
        vector, lambda c: F.least(F.greatest(F.floor(c.cast("double") * F.lit(scale)), F.lit(-most)), F.lit(most)) + F.lit(shift)
    )


def _usable(vector: Column) -> Column:
    c = lambda x: x.cast("double")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(c(x)) | (F.abs(c(x)) == F.lit(math.inf)))
    return vector.isNotNull() & ~bad


def number_rows(rows: DataFrame, label: str = "embeddings") -> DataFrame:
    """The rows with ``index`` from 0 without gaps: the places within tasks after the counts of the tasks before."""
    kept = stage(rows.withColumn("index", F.monotonically_increasing_id()), label)
    task = F.shiftright("index", 33)
    counts = kept.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("count")).orderBy("task").collect()  # one row a task
    starts, upto = [], 0
    for r in counts:
        starts.append((r["task"], upto))
        upto += r["count"]
    before = kept.sparkSession.createDataFrame(starts, "task bigint, before bigint")
    place = F.col("index").bitwiseAND(F.lit((1 << 33) - 1))
    # Sent to all: a row for each task that wrote, two numbers wide.
    return kept.withColumn("task", task).join(F.broadcast(before), "task").withColumn("index", F.col("before") + place).drop("task", "before")


def block_matrix(rows: DataFrame, vector: Column, count: int, width: int) -> BlockMatrix:
    """Rows (index, array of doubles) as blocks as wide as a row."""
    most = max(BLOCK_ROWS, BLOCK_BYTES // (8 * width))
    tall = min(most, max(BLOCK_ROWS, math.ceil(count / BLOCKS)))
    indexed = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(vector).alias("vector")), "vector")
    return IndexedRowMatrix(indexed, count, width).toBlockMatrix(tall, width)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """matrix' * matrix: a product a block of rows, summed block by block."""
    turned = matrix.transpose()
    # Python's multiply lacks the number of splits of the middle dimension that the Scala method takes.
    wrapped = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, matrix.numRowBlocks)
    return BlockMatrix(wrapped, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def fit(rows: DataFrame, count: int, width: int, components: int) -> tuple[Fit, BlockMatrix]:
    """Components of the covariance of ``x``, and the centred rows as blocks."""
    totals = rows.agg(*[F.sum(F.col("x")[k].cast("decimal(28,0)")).alias(f"s{k}") for k in range(width)]).first()
    sums = [int(s) for s in totals]
    means = F.array(*[F.lit(s / count) for s in sums])
    centred = block_matrix(rows, F.zip_with("x", means, lambda x, m: x.cast("double") - m), count, width)
    centred.persist(StorageLevel.MEMORY_AND_DISK)  # three products read the blocks; a lost one is made again
    covariance = scatter(centred) / count
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(values)[::-1][:components]
    return Fit(count, sums, values[order], vectors[:, order], float(np.trace(covariance))), centred


def project(spark: SparkSession, fitted: Fit, centred: BlockMatrix) -> DataFrame:
    """(index, y): every row on the components, over the roots of their eigenvalues."""
    useful = fitted.useful
    weights = fitted.vectors * np.where(useful, 1 / np.sqrt(np.where(useful, fitted.values, 1)), 0)
    local: DenseMatrix = Matrices.dense(*weights.shape, weights.ravel(order="F").tolist())
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), weights.shape[0], weights.shape[1])
    projected = centred.multiply(right).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)  # .rows, without a way through Python
    frame = MLUtils.convertVectorColumnsToML(found, "vector")
    return frame.select("index", vector_to_array("vector").alias("y"))


def identity_error(projected: DataFrame, useful: np.ndarray) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity."""
    own = np.flatnonzero(useful).tolist()
    pairs = [(i, j) for i in own for j in own if i <= j]
    if not pairs:
        return 0.0
    found = projected.agg(*[F.covar_pop(F.col("y")[i], F.col("y")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(value - (i == j)) for (i, j), value in zip(pairs, found, strict=True))


def whiten(
    embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8, scale: int = SCALE, shift: int = SHIFT
) -> DataFrame:
    """key, component, n, deviation (exact, decimal), whitened, explained, identity_error per row and component."""
    spark = embeddings.sparkSession
    given = embeddings.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter(_usable(F.col("vector")))
    rows = number_rows(given.select("key", whole_numbers(F.col("vector"), scale, shift).alias("x")))
    count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    schema = f"{key} {rows.schema['key'].dataType.simpleString()}, component int, n long, deviation decimal(38,0)"
    if not count or not width:
        return spark.createDataFrame([], f"{schema}, whitened double, explained double, identity_error double")
    lacking = F.array_repeat(F.lit(shift).cast("long"), (F.lit(width) - F.size("x")).cast("int"))
    rows = rows.withColumn("x", F.concat("x", lacking))
    fitted, centred = fit(rows, count, width, min(components, width))
    projected = stage(project(spark, fitted, centred), "whitened")
    useful = fitted.useful
    error = identity_error(projected, useful)

    exact = "decimal(38,0)"
    sums = F.array(*[F.lit(str(s)).cast(exact) for s in fitted.sums])
    times = F.lit(count).cast("decimal(19,0)")
    far = F.zip_with("x", sums, lambda x, s: F.try_subtract(F.try_multiply(x.cast("decimal(19,0)"), times).cast(exact), s).cast(exact))
    square = F.aggregate(far, F.lit(0).cast(exact), lambda t, d: F.try_add(t, F.try_multiply(d, d).cast(exact)).cast(exact))
    explained = (fitted.values / fitted.trace if fitted.trace > 0 else np.zeros(len(fitted.values))).tolist()
    shown = F.array(
        *[
            F.struct(
                F.lit(k + 1).alias("component"),
                (F.col("y")[k] if useful[k] else F.lit(None).cast("double")).alias("whitened"),
                F.lit(explained[k]).alias("explained"),
            )
            for k in range(len(explained))
        ]
    )
    joined = rows.select("index", "key", square.alias("deviation")).join(projected, "index")
    return joined.select("key", "deviation", F.explode(shown).alias("c")).select(
        F.col("key").alias(key),
        "c.component",
        F.lit(count).cast("long").alias("n"),
        "deviation",
        "c.whitened",
        "c.explained",
        F.lit(error).alias("identity_error"),
    )
