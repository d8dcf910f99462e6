"""Embedding whitening: MLlib's singular values of centred distributed rows; total variance from exact deviations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitetide.session import ship, table, written

#: Entries are kept as whole steps of one in SCALE.
SCALE = 256
COMPONENTS = 4
#: Directions whose singular value is below this share of the largest are rounding, not variance.
RANK = 1e-7
#: Exact sums: whole numbers of up to 38 digits.
EXACT = "decimal(38,0)"


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: each usable vector in whole steps, floor(scale * c); the other rows go.

    Usable: not null, no null or non-finite entry, and as many entries as most vectors have (of equally common lengths the
    longest). Written once, as several steps read it.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & finite)
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    rows = written(rows.select("vec_id", x.alias("x")), "scaled")
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    return rows.filter(F.size("x") == (common or 0)) if common is not None else rows


def moments(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""
    n = fit.count()
    sums = fit.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    return n, [int(r["s"]) for r in sums.orderBy("k").collect()]  # one number for each dimension


def _list(values: list[int]) -> F.Column:
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), f"array<{EXACT}>")


def deviation(x: F.Column, n: int, sums: list[int]) -> F.Column:
    """Sum over the dimensions of (n * x - S)^2, exact; null where it does not fit into a long."""
    gaps = F.zip_with(x, _list(sums), lambda v, s: (v.cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)") - s).cast(EXACT))
    squares = F.transform(gaps, lambda g: F.try_multiply(g, g).cast(EXACT))
    return F.aggregate(squares, F.lit(0).cast(EXACT), lambda a, b: F.try_add(a, b).cast(EXACT))


@dataclass
class Whitening:
    """What was fitted: distinct rows and their mean, components (one a column) by falling variance, and their shares."""

    n: int
    sums: list[int]
    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    explained: np.ndarray


def centred(fit: DataFrame, mean: np.ndarray) -> DataFrame:
    """The rows less their mean, as one column of MLlib vectors; nothing leaves the executors' JVMs."""
    middle = F.from_json(F.lit("[" + ",".join(map(repr, mean.tolist())) + "]"), "array<double>")
    rows = fit.select(array_to_vector(F.zip_with("x", middle, lambda v, m: v.cast("double") - m)).alias("row"))
    return MLUtils.convertVectorColumnsFromML(rows, "row")


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """A whitening of the distinct rows of ``rows (x)``, and these rows; None where no direction varies.

    MLlib sums the Gram matrix of the centred rows over a tree of tasks and decomposes it on the driver; its size is that
    of a vector, whatever the number of rows. All singular values are asked for, as only then it takes the direct solver,
    which is exact to double precision. A variance is a squared singular value over the number of rows; the total that
    the shares refer to does not come from the matrix but from the exact deviations.
    """
    fit = written(rows.select("x").distinct(), "fit")
    n, sums = moments(fit)
    if not n or not sums:
        return None, fit
    mean = np.array([s / n for s in sums])
    whole = fit.agg(F.sum(deviation(F.col("x"), n, sums).cast("double"))).first()[0]
    if not whole:
        return None, fit
    svd = RowMatrix(centred(fit, mean)).computeSVD(len(sums), computeU=False, rCond=RANK)
    values = np.array(svd.s.toArray())[:components]
    variance = values**2 / n
    return Whitening(n, sums, mean, svd.V.toArray()[:, : len(values)], variance, variance / (whole / n**3)), fit


def whitened(rows: DataFrame, fitted: Whitening, name: str = "w") -> DataFrame:
    """``rows`` (with a column ``x``) and each row's coordinates along the components, over their standard deviations."""
    ship(rows.sparkSession)
    at, mean, turn = rows.columns.index("x"), fitted.mean, fitted.components / np.sqrt(fitted.variance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(mean))
            made = pa.array(list((x - mean) @ turn), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, {name} array<double>")


def identity_error(fit: DataFrame, fitted: Whitening) -> float:
    """The largest entry by which the covariance of the whitened rows (centred, divisor n) differs from the identity."""
    k = len(fitted.variance)
    w = whitened(fit, fitted).select([F.col("w")[i].alias(f"w{i}") for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = w.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row for each vector and component.

    Fitted on each distinct vector once, so copies carry no weight; copies are dropped before they are shuffled. Repeated
    rows, null ids and ties are treated as any other row; rows with a null vector, null or non-finite entries or an
    uncommon length are left out; fewer components are given where fewer directions vary, and no row where none does or
    the table is empty. Columns other than ``vec_id`` and ``embedding`` are ignored.
    """
    rows = scaled(vectors)
    fitted, fit = fit_whitening(rows, components)
    if fitted is None:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(fit, fitted)
    share = F.array(*[F.lit(float(e)) for e in fitted.explained])
    exact = deviation(F.col("x"), fitted.n, fitted.sums)
    made = whitened(rows.withColumn("deviation", exact.try_cast("long")), fitted)
    each = made.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return each.select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share[F.col("k")].alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
