"""Embedding whitening with MLlib's BlockMatrix.

Centred rows get consecutive indexes and become distributed blocks of ``ROWS`` rows. The transpose times the matrix is
the scatter, whose sum is spread over ``splits`` of the inner dimension, as one block of a result would else be one
task. Its eigenvectors come from a local ``eigh`` of a matrix as large as the dimension squared; the blocks times the
whitening matrix are the projected rows. Fit rows are distinct, so that copies count once; all rows are projected.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.tables import written

#: Rows and columns of a block.
ROWS, COLUMNS = 2048, 1024


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` for each row and its first components.

    ``vectors`` holds arrays of whole numbers x (up to 2^53). The fit list is each distinct vector once; n is its length,
    S its sum. ``deviation`` is the exact sum of (n * x - S)^2, a decimal (null beyond 38 digits). Components are unit eigenvectors of the fit
    list's covariance (divisor n) by falling eigenvalue e; ``whitened`` is x - S / n on the component over the root of e,
    ``explained`` its share of the trace, ``identity_error`` how far the covariance of the whitened fit list is from the
    identity at most. Along a component without variance (e within rounding of 0) nothing can be whitened: ``whitened`` is
    null there, and the identity is only asked of the others; without any variance ``explained`` and ``identity_error``
    are null too.

    Rows whose vector is null or holds a null take no part; a vector shorter than the longest counts as filled up with
    zeros. A null or repeated id is kept: every row gets its results. There are no more components than dimensions. An
    empty table, or one of empty vectors, gives an empty one. Other columns are not read.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v is not null and size(v) > 0 and not exists(v, e -> e is null)")
    seen = own.agg(F.max(F.size("v")).alias("d"), F.max(F.array_max("v")).alias("high"), F.min(F.array_min("v")).alias("low")).first()
    d = seen["d"]
    if d is None:
        kind = dict(own.dtypes)["id"]
        return spark.createDataFrame([], f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    rows = _indexed(own.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("v")))), "rows")
    fit = _indexed(rows.select("v").distinct(), "fit")
    sums = fit.agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(d))).first()
    n, total = sums["n"], [int(sums[f"s{i}"]) for i in range(d)]

    # n * x - S is a whole number; it is a long where the sum of squares can be one, else a decimal.
    wide = d * (n * (seen["high"] - seen["low"])) ** 2 >= 1 << 63 or n * max(abs(seen["high"]), abs(seen["low"])) >= 1 << 63
    kind = "decimal(38,0)" if wide else "long"
    sum_ = F.array(*(F.lit(str(s)).cast(kind) for s in total))
    off = F.zip_with("v", sum_, lambda x, s: x.cast(kind) * F.lit(str(n)).cast(kind) - s)
    squares = F.aggregate(F.transform("off", lambda x: F.try_multiply(x, x).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"), lambda a, x: F.try_add(a, x).cast("decimal(38,0)"))
    centred = F.transform("off", lambda x: x.cast("double") / n)

    matrix = _blocks(fit.withColumn("off", off).select("index", centred.alias("v")), n, d)
    splits = min(-(-n // ROWS), 2 * spark.sparkContext.defaultParallelism)
    values, directions = np.linalg.eigh(_times(matrix.transpose(), matrix, splits).toLocalMatrix().toArray() / n)
    k = min(components, d)
    values, directions = values[::-1], directions[:, ::-1][:, :k]
    trace = float(values.sum())
    alive = [bool(e > max(0.0, trace) * d * np.finfo(float).eps) for e in values[:k]]
    scale = np.array([1 / np.sqrt(e) if a else 0.0 for e, a in zip(values, alive, strict=False)])
    whitening = _local(spark, directions * scale)

    done = matrix.multiply(whitening)
    second = _times(done.transpose(), done, splits).toLocalMatrix().toArray() / n
    error = np.abs(second - np.eye(k))[np.ix_(alive, alive)]  # the fit rows are centred, and so are their projections
    count = rows.count()
    all_ = _blocks(rows.withColumn("off", off).select("index", centred.alias("v")), count, d).multiply(whitening)
    projected = callMLlibFunc("getIndexedRows", all_.toIndexedRowMatrix()._java_matrix_wrapper._java_model)

    held = rows.withColumn("off", off).select("index", "id", squares.alias("deviation"))
    facts = F.array(*(F.struct(F.lit(i + 1).alias("component"), F.lit(alive[i]).alias("alive"), F.lit(float(values[i] / trace) if trace > 0 else None).cast("double").alias("explained")) for i in range(k)))
    each = held.join(projected.select("index", vector_to_array("vector").alias("w")), "index").select("id", "deviation", F.explode(F.arrays_zip(facts.alias("facts"), F.col("w"))).alias("p"))
    return each.select(
        "id", "p.facts.component", F.lit(n).cast("long").alias("n"), "deviation", F.when(F.col("p.facts.alive"), F.col("p.w")).alias("whitened"), "p.facts.explained",
        F.lit(float(error.max()) if error.size else None).cast("double").alias("identity_error"),
    )


def _indexed(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table with ``index``, consecutive from 0: places within tasks, and where each task begins, from one count a task."""
    table = written(df.withColumn("place", F.monotonically_increasing_id()), name)
    task = F.shiftright("place", 33)
    counts = sorted((r["task"], r["n"]) for r in table.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    begins = df.sparkSession.createDataFrame(starts, "task long, begin long")
    return table.withColumn("task", task).join(begins, "task").withColumn("index", F.col("begin") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("task", "begin", "place")


def _blocks(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """``rows(index, v)`` as dense blocks, made in the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("v").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(ROWS, COLUMNS)


def _times(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a * b with the inner dimension dealt over ``splits`` tasks, each of which adds up its blocks before they are sent."""
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, max(1, splits))
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def _local(spark, matrix: np.ndarray) -> BlockMatrix:
    """A small matrix as a BlockMatrix whose rows are cut like the columns of a large one."""
    d, k = matrix.shape
    blocks = [((i, 0), DenseMatrix(min(COLUMNS, d - i * COLUMNS), k, matrix[i * COLUMNS : (i + 1) * COLUMNS].ravel(order="F"))) for i in range(-(-d // COLUMNS))]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, 1), COLUMNS, k, d, k)
