"""Whitening of embeddings with the block matrices of Spark MLlib.

Centred vectors, numbered from 0, are the rows of a matrix that is cut into blocks of bounded size. Its transpose times
itself is the scatter matrix, dimension by dimension, which one machine can decompose. The vectors times the whitening
matrix, again as block matrices, are the whitened vectors: their components are uncorrelated and of variance 1.

The fit sees each distinct vector once, so that copies have no weight; all vectors are projected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.llm.topk import whole_numbers
from gridlore.session import materialise

COMPONENTS = 4
SCALE = 256
BLOCK_ENTRIES = 1 << 19  # numbers of one block, 4 MB
TASK_BLOCKS = 8  # pairs of blocks that one task multiplies
NO_VARIANCE = 1e-12  # of the largest eigenvalue: components at or below have no variance but rounding


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with their sums by dimension; unit eigenvectors as columns, by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def matrix(self, k: int) -> np.ndarray:
        """Dimensions by components: what a centred vector is multiplied by. Components without variance give 0."""
        return whitening_matrix(self.eigenvalues, self.vectors, k)


def whitening_matrix(eigenvalues: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    has = eigenvalues[:k] > NO_VARIANCE * max(eigenvalues.max(initial=0.0), 0.0)
    scale = np.where(has, 1 / np.sqrt(np.where(has, eigenvalues[:k], 1.0)), 0.0)
    return vectors[:, :k] * scale


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and x, the whole numbers of the vectors that take part.

    Vectors that are null or empty, or hold null or non-finite entries, take no part, nor do those of another length than
    most vectors have (of equally common lengths, the largest counts).
    """
    whole = vectors.select("vec_id", whole_numbers(F.col("embedding"), scale).alias("x")).filter(F.size("x") > 0)
    size = whole.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    return whole.filter(F.size("x") == (size[0].d if size else 0))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The table, written, with the numbers 0, 1, 2, … in ``index``; no task sees more than its own rows."""
    rows = materialise(df.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_own", part).join(offsets, F.col("_own") == F.col("_part")).withColumn("index", F.col("_offset") + own).drop(
        "_at", "_own", "_part", "_offset"
    )


def block_matrix(rows: DataFrame, sums: tuple[int, ...], n: int) -> BlockMatrix:
    """The vectors ``x`` less their mean, in blocks of whole rows."""
    mean = F.lit([s / n for s in sums])
    centred = F.zip_with("x", mean, lambda a, m: a.cast("double") - m)
    frame = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(centred).alias("vector")), "vector")
    return IndexedRowMatrix(frame, 0, len(sums)).toBlockMatrix(max(1, BLOCK_ENTRIES // len(sums)), len(sums))


def scatter(m: BlockMatrix) -> np.ndarray:
    """The transpose of a matrix times the matrix. The rows are split, so that a task multiplies few pairs of blocks."""
    blocks = -(-m.numRows() // m.rowsPerBlock)
    model = m._java_matrix_wrapper._java_model
    # the form with a number of splits of the inner dimension is not part of the Python class
    product = m.transpose()._java_matrix_wrapper.call("multiply", model, max(1, blocks // TASK_BLOCKS))
    return BlockMatrix(product, m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()


def times(m: BlockMatrix, matrix: np.ndarray, spark: SparkSession) -> BlockMatrix:
    """A matrix times a local one of one block, which goes to every task."""
    d, k = matrix.shape
    place = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType())])
    kind = T.StructType([T.StructField("place", place), T.StructField("block", MatrixUDT())])
    block = spark.createDataFrame([((0, 0), Matrices.dense(d, k, matrix.flatten("F").tolist()))], kind)
    other = callMLlibFunc("createBlockMatrix", block, d, k, d, k)
    product = m._java_matrix_wrapper.call("multiply", other)
    return BlockMatrix(product, m.rowsPerBlock, k)


def fit(rows: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``rows`` (``usable``); None without any."""
    distinct = numbered(rows.select("x").dropDuplicates(), "distinct-vectors")
    sums = distinct.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(
        F.sum(F.col("v").cast("decimal(19,0)")).alias("s"), F.count("*").alias("n")
    ).orderBy("d").collect()  # one row per dimension
    if not sums:
        return None
    n, totals = sums[0].n, tuple(int(r.s) for r in sums)
    m = block_matrix(distinct, totals, n)
    covariance = scatter(m) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    whitening = whitening_matrix(values, vectors, k)
    has = np.flatnonzero(np.abs(whitening).max(axis=0, initial=0) > 0)
    error = np.abs(scatter(times(m, whitening, rows.sparkSession)) / n - np.eye(whitening.shape[1]))[np.ix_(has, has)].max(initial=0.0)
    return Whitening(n, totals, values, vectors, float(np.trace(covariance)), float(error))


def deviation(x: Column, n: int, sums: tuple[int, ...]) -> Column:
    """The sum over dimensions of (n * x - S)**2, exact; null beyond what a decimal of 38 digits or a long can hold."""
    kind = "decimal(38,0)"

    def square(a: Column, s: Column) -> Column:
        apart = F.try_subtract(F.try_multiply(a.cast("decimal(19,0)"), F.lit(n).cast("decimal(19,0)")).cast(kind), s).cast(kind)
        return F.try_multiply(apart, apart).cast(kind)

    each = F.zip_with(x, F.lit([str(s) for s in sums]).cast(f"array<{kind}>"), square)
    total = F.aggregate(each, F.lit(0).cast(kind), lambda t, v: F.try_add(t, v).cast(kind))
    return total.try_cast("long")


def whiten(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector that takes part and component.

    Vectors that take no part have no rows (``usable``); repeated rows and missing ids each keep theirs. There are as many
    components as dimensions at most. A component without variance, such as all of one distinct vector, has null in
    ``whitened``; ``explained`` is null if no dimension varies. Eigenvectors of one eigenvalue are any that fit. Without any
    usable vector the result is empty. Other columns are not read.
    """
    rows = numbered(usable(vectors, scale), "vectors")
    model = fit(rows, k)
    if model is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )
    whitening = model.matrix(k)
    product = times(block_matrix(rows, model.sums, model.n), whitening, rows.sparkSession).toIndexedRowMatrix()
    projected = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    projected = projected.select(F.col("index").alias("_index"), vector_to_array(F.col("vector")).alias("_whitened"))
    joined = rows.withColumn("_deviation", deviation(F.col("x"), model.n, model.sums)).join(projected, F.col("index") == F.col("_index"))
    has = np.abs(whitening).max(axis=0) > 0
    explained = [float(e / model.trace) if model.trace > 0 else None for e in model.eigenvalues[: whitening.shape[1]]]
    component = F.array(*(
        F.struct(
            F.lit(i + 1).alias("component"), (F.get("_whitened", F.lit(i)) if has[i] else F.lit(None).cast("double")).alias("whitened"),
            F.lit(explained[i]).cast("double").alias("explained"),
        )
        for i in range(whitening.shape[1])
    ))
    each = joined.select("vec_id", "_deviation", F.explode(component).alias("_c"))
    return each.select(
        "vec_id", "_c.component", F.lit(model.n).cast("long").alias("n"), F.col("_deviation").alias("deviation"), "_c.whitened", "_c.explained",
        F.lit(model.identity_error).alias("identity_error"),
    )
