"""Whitening of embeddings by the singular value decomposition of the centred rows.

Entries are put on whole numbers, x = floor(1024 c) + 100000, so sums over dimensions and rows are exact.  The rows less their
means are a distributed ``RowMatrix`` of MLlib, whose ``computeSVD`` gives the components; a singular value s stands for the
eigenvalue s^2 / n of the covariance with divisor n.  All components are asked for, so that MLlib solves the whole Gram matrix
(d x d, summed over the cluster) directly instead of iterating to a tolerance.  The total variance is not the sum of what was
decomposed: it is added up from the exact deviations, sum over dimensions of (n x - S)^2, in decimal arithmetic.

Edge cases: rows whose vector is null, or holds null or non-finite entries, are dropped, and so are vectors of fewer dimensions
than the longest (empty ones too) and those with entries beyond 2^40, which have no whole number to compute with.  Components
without variance cannot be scaled and are left out, so equal vectors, a single one and an empty table give no rows.
``deviation`` is null where it exceeds a long; the sum for the total variance is then still exact.  Repeated rows and null ids
count as any other; columns other than id and vector are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames

COMPONENTS, SCALE, SHIFT, MOST = 8, 1024, 100_000, float(1 << 40)


def whole(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """key and x (array of longs) of the rows that remain, and their number of dimensions."""
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = F.forall(c, lambda v: v.isNotNull() & (F.abs(v) <= MOST))  # also drops NaN, which is above all numbers
    kept = rows.select(F.col(key).alias("_key"), c.alias("c")).filter(F.col("c").isNotNull() & good)
    dims = kept.agg(F.max(F.size("c"))).first()[0] or 0
    x = F.transform("c", lambda v: F.floor(v * SCALE).cast("long") + SHIFT)
    return kept.filter((F.size("c") == dims) & (F.size("c") > 0)).select("_key", x.alias("x")), dims


def sums(x: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """The number of rows and the sum of each dimension; every task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, np.int64)
        for batch in batches:
            n += batch.num_rows
            total += batch.column(0).flatten().to_numpy().reshape(-1, dims).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], names=["at", "sum"])

    found = {r["at"]: r["total"] for r in x.select("x").mapInArrow(run, "at int, sum long").groupBy("at").agg(F.sum("sum").alias("total")).collect()}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(dims)], np.int64)


def _centred(means: np.ndarray) -> Column:
    return F.zip_with("x", F.lit(means.tolist()), lambda v, m: v - m)


def components(x: DataFrame, n: int, means: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and its unit eigenvectors as columns; none of those without variance."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    rows = MLUtils.convertVectorColumnsFromML(x.select(array_to_vector(_centred(means)).alias("row")), "row")
    if n == 0 or x.filter(F.exists(_centred(means), lambda v: v != 0)).isEmpty():
        return np.zeros(0), np.zeros((len(means), 0))
    svd = RowMatrix(rows, n, len(means)).computeSVD(len(means), computeU=False)
    s, v = svd.s.toArray()[:most], svd.V.toArray()[:, :most]
    return s * s / n, v


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error of each remaining row and component."""
    x, dims = whole(rows, key, vector)
    kind = x.schema["_key"].dataType
    empty = T.StructType([T.StructField(key, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]])
    spark = rows.sparkSession
    n, total = sums(x, dims) if dims else (0, np.zeros(0, np.int64))
    #: The exact quotient, rounded once.
    means = np.array([int(s) / n for s in total]) if n else np.zeros(dims)
    values, vectors = components(x, n, means, most) if n else (np.zeros(0), np.zeros((dims, 0)))
    k = len(values)
    if not k:
        return spark.createDataFrame([], empty)
    apart = F.zip_with("x", F.lit(total.tolist()), lambda v, s: (F.lit(n) * v - s).cast("decimal(19,0)"))
    deviation = F.aggregate(apart, F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v * v).cast("decimal(38,0)"))
    #: A component scaled by its deviation, as it is multiplied with every row.
    scaled = (vectors / np.sqrt(values)).T
    dot = lambda w: F.aggregate(F.zip_with("r", F.lit(w.tolist()), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    w = x.select("_key", deviation.alias("d"), _centred(means).alias("r")).select("_key", "d", F.array(*[dot(v) for v in scaled]).alias("w"))
    first = w.agg(F.sum("d").alias("d"), *[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    variance = float(Decimal(first["d"]) / Decimal(n) ** 3)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    second = w.agg(*[F.avg((F.col("w")[i] - first[f"m{i}"]) * (F.col("w")[j] - first[f"m{j}"])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(second[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    #: The array of the shares is one literal.
    out = w.select("_key", F.col("d").try_cast("long").alias("deviation"), F.posexplode("w").alias("at", "whitened"))
    share = F.element_at(F.lit((values / variance).tolist()), F.col("at") + 1)
    return out.select(F.col("_key").alias(key), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(float(error)).alias("identity_error"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(frames.table(spark, sf_dir, "embeddings"))
