"""Whitening of embeddings by the singular value decomposition of centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import finite_vector, floored, scoped, stored

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Whitened components at most.
COMPONENTS = 8
#: Singular values below this share of the largest are rounding: their components have no variance.
RANK = 1e-6
#: Exact sums are decimals of so many digits.
EXACT = "decimal(38,0)"
#: Products and sums of int64 below this do not overflow.
SAFE = 2.0**62


@dataclass(frozen=True)
class Whitening:
    """What is fitted: rows, their exact sums, the components and their eigenvalues, the total variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # component x dimension
    eigenvalues: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def _matrices(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        lists = batch.column(column)
        if len(lists):
            yield batch, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of each dimension over a task's rows: a row a dimension."""
    total: np.ndarray | None = None
    for _, x in _matrices(batches, 0):
        safe = np.abs(x).max(initial=0).astype(np.float64) * len(x) < SAFE
        part = x.sum(axis=0).astype(object) if safe else x.astype(object).sum(axis=0)
        total = part if total is None else total + part
    if total is not None:
        exact = pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), exact], ["d", "s"])


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """sum over dimensions of (n * x - S)^2 of each row, exact at any size."""
    most = max(float(np.abs(x).max(initial=0)) * n, max((abs(float(s)) for s in sums), default=0.0))
    apart = n * x - np.array(sums, dtype=np.int64) if most < SAFE / 2 else n * x.astype(object) - np.array(sums, dtype=object)
    if most < SAFE / 2 and np.abs(apart).max(initial=0).astype(np.float64) ** 2 * max(1, x.shape[1]) >= SAFE:
        apart = apart.astype(object)
    return [int(v) for v in (apart * apart).sum(axis=1)]


def _deviating(fit_n: int, sums: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def deviating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _matrices(batches, 0):
            total = Decimal(sum(deviations(x, fit_n, sums)))
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.decimal128(38, 0))], ["deviation"])

    return deviating


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit to a stored table with arrays ``x`` of integers of one length; None without rows.

    Sums are exact. The rows less their mean form a distributed matrix, of
    which Spark's ``computeSVD`` gives the right singular vectors; an
    eigenvalue of the covariance is a singular value squared, over n. With as
    many values asked for as there are dimensions, the decomposition of the
    summed products is a dense one, to double precision; the driver holds a
    matrix of dimensions squared, no rows. The total variance does not come
    from it, but from the exact deviations. A component without variance
    cannot be whitened; there are as many components as have any.
    """
    held = vectors.select("x").mapInArrow(_sums, f"d long, s {EXACT}").groupBy("d").agg(F.sum("s").alias("s")).orderBy("d").collect()  # a row a dimension
    n = vectors.count()
    if not n:
        return None
    sums = tuple(int(r["s"]) for r in held)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    deviation = vectors.select("x").mapInArrow(_deviating(n, sums), f"deviation {EXACT}").agg(F.sum("deviation")).first()[0]
    trace = float(Fraction(int(deviation), n**3))
    if not trace:
        return Whitening(n, sums, np.zeros((0, len(sums))), np.zeros(0), 0.0)
    centre = F.lit(mean.tolist()).cast("array<double>")
    centred = vectors.select(array_to_vector(F.zip_with("x", centre, lambda x, m: x.cast("double") - m)).alias("row"))
    rows = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "row"), n, len(sums))
    found = rows.computeSVD(len(sums), computeU=False, rCond=RANK)
    values = np.asarray(found.s.toArray()) ** 2 / n
    by = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, sums, np.asarray(found.V.toArray()).T[by], values[by], trace)


def _whitened(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        turned = model.components.T / np.sqrt(model.eigenvalues)
        mean = model.mean
        for batch, x in _matrices(batches, 1):
            found = (x - mean) @ turned
            exact = pa.array([Decimal(d) for d in deviations(x, model.n, model.sums)], pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, max(1, found.shape[1]))[: len(x) + 1] if found.shape[1] else np.zeros(len(x) + 1, dtype=np.int32), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), exact, lists], ["vec_id", "deviation", "whitened"])

    return whiten


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation (exact), whitened (an array, a value a component) of each row of ``x``."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # components x dimensions
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "x").mapInArrow(_whitened(shared), f"vec_id {kind}, deviation {EXACT}, whitened array<double>")


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest absolute entry of the whitened values' covariance (divisor n, centred first) less the identity."""
    if not k:
        return 0.0
    at = [F.col("whitened")[i] for i in range(k)]
    means = whitened.agg(*(F.avg(c) for c in at)).first()
    apart = [c - F.lit(m) for c, m in zip(at, means, strict=True)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    covariance = whitened.agg(*(F.avg(apart[i] * apart[j]) for i, j in pairs)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(covariance, pairs, strict=True))


def prepared(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and x, the integer entries, of the rows that take part."""
    ready = vectors.where(finite_vector("embedding")).select("vec_id", floored("embedding", scale).alias("x"))
    return ready.select("vec_id", F.transform("x", lambda v: v + F.lit(shift).cast("long")).alias("x"))


@scoped
def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Takes ``vec_id`` and ``embedding``; other columns are ignored. Vectors that
    are null, empty or hold a null or non-finite entry take no part. All
    others must have one length; if not, those of the most frequent length
    (of several the shortest) take part. Entries become integers; the fit is
    over all rows that take part, repeated ones and those without an id as
    often as they are there. ``deviation`` is the exact sum of (n * x - S)^2, a
    decimal. ``explained`` is an eigenvalue's share of the total variance.
    Rows that are all equal have no variance and so no component; they and an
    empty table give an empty result.
    """
    spark = vectors.sparkSession
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation {EXACT}, whitened double, explained double, identity_error double"
    ready = stored(prepared(vectors, scale, shift), "vectors")
    length = ready.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    model = fit(ready.where(F.size("x") == length["dims"]), components) if length else None
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], schema)
    found = stored(transform(ready.where(F.size("x") == length["dims"]), model), "whitened", keep=True)
    error = identity_error(found, len(model.eigenvalues))
    shares = F.lit((model.eigenvalues / model.trace).tolist()).cast("array<double>")
    each = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
