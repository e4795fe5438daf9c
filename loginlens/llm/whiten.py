"""Whitening of embeddings: vectors are centred, turned to their principal axes and scaled to unit variance.

The scatter of the centred integer vectors is summed per partition and added up in Spark; only its d x d entries reach
the driver. A Cholesky factorisation with diagonal pivots writes it as L L'. One-sided Jacobi rotations make the columns
of L orthogonal: their squared lengths are the eigenvalues, the columns divided by their lengths the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loginlens.llm.common import delete_stored, stored

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
SWEEPS = 60
#: Largest scaled entry; beyond it a long would not hold its integer.
MOST = float(1 << 62)
#: Tasks that partial sums are added in.
ADDERS = 64


def integer_vector(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift)


def usable(vector: Column, scale: int = SCALE) -> Column:
    """Whether the vector is there, not empty, and all its entries are finite numbers that fit."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) * scale < MOST)), F.lit(False))


def integer_rows(df: DataFrame, vector: str, scale: int = SCALE, shift: int = SHIFT, name: str = "x") -> DataFrame:
    """The rows whose vectors take part, with their integer vectors in ``name`` in place of ``vector``.

    Left out are null and empty vectors and those with null, non-finite or too large entries (NaN counts as larger than
    any number), and vectors of another length than most have (of equally common lengths the greatest counts).
    """
    rows = df.filter(usable(F.col(vector), scale))
    common = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.filter(F.size(vector) == (common["d"] if common else 0))
    return rows.withColumn(name, integer_vector(F.col(vector), scale, shift)).drop(*[vector] if vector != name else [])


def matrix_of(column: pa.ListArray) -> np.ndarray:
    """The rows of a batch of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns, as Python numbers where a long might overflow."""
    if not len(x):
        return []
    safe = max(abs(int(x.max())), abs(int(x.min()))) * len(x) < 1 << 62
    return [int(s) for s in (x if safe else x.astype(object)).sum(axis=0)]


def added(parts: DataFrame, size: int) -> np.ndarray:
    """The matrix that rows (i, v) of partial sums add up to. They are dealt by ``i`` and added as they arrive."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), matrix_of(batch.column(1))):
                sums[i] = sums[i] + v if i in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["i", "v"])

    total = np.zeros((size, size))
    for r in parts.repartition(min(size, ADDERS), "i").mapInArrow(add, parts.schema).collect():
        total[r["i"]] = r["v"]
    return total


def product_sums(rows: DataFrame, turned, size: int) -> np.ndarray:
    """The sum of z z' over all rows, with z = ``turned``(x), a row each: partition sums, added up in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            z = turned(matrix_of(batch.column(0)))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    return added(rows.mapInArrow(run, "i int, v array<double>"), size)


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """L with scatter = L L', its rows in the order of the entries, its columns in that of the pivots.

    Each step takes the largest diagonal entry left, so L is triangular in pivot order; it ends where what is left is
    rounding, and has as many columns as the scatter has rank.
    """
    d = len(scatter)
    left, factor = scatter.astype(np.float64).copy(), np.zeros((d, d))
    open_ = np.ones(d, dtype=bool)
    smallest = d * np.finfo(np.float64).eps * max(float(left.diagonal().max(initial=0.0)), 0.0)
    for k in range(d):
        diagonal = np.where(open_, left.diagonal(), -np.inf)
        p = int(diagonal.argmax())
        if not diagonal[p] > smallest:
            return factor[:, :k]
        column = np.where(open_, left[:, p], 0.0) / np.sqrt(diagonal[p])
        column[p] = np.sqrt(diagonal[p])
        factor[:, k] = column
        left -= np.outer(column, column)
        open_[p] = False
    return factor


def jacobi(factor: np.ndarray, tolerance: float = 4 * np.finfo(np.float64).eps) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of L L', falling, and its unit eigenvectors as columns, by rotating the columns of L.

    All pairs of columns meet once a sweep, in rounds of pairs that have no column in common.
    """
    a = factor.copy()
    r = a.shape[1]
    order = list(range(r)) + ([-1] if r % 2 else [])
    half = len(order) // 2
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(order) - 1):
            pairs = [(p, q) for p, q in zip(order[:half], reversed(order[half:])) if p >= 0 and q >= 0]
            order = [order[0], order[-1], *order[1:-1]]
            if not pairs:
                continue
            p, q = (np.array(x) for x in zip(*pairs))
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(xx * yy)
            cosine = np.abs(np.divide(xy, size, out=np.zeros_like(xy), where=size > 0))
            worst = max(worst, float(cosine.max()))
            turn = cosine > tolerance
            zeta = (yy - xx) / (2 * np.where(turn, xy, 1.0))
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = np.where(turn, 1 / np.hypot(1.0, t), 1.0)
            s = np.where(turn, c * t, 0.0)
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
        if worst <= tolerance:
            break
    values = (a * a).sum(axis=0)
    falling = np.argsort(-values, kind="stable")
    return values[falling], a[:, falling] / np.sqrt(values[falling])


@dataclass
class Whitening:
    """Sums and components of the fit list: ``rows`` different vectors with the sums ``sums`` of each dimension."""

    rows: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / rows. The whole part of the means is taken off exactly, so large means cost no digits."""
        whole = np.array([s // self.rows for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.rows) / self.rows for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over the dimensions of (rows * x - sums)**2, exact; None where a long does not hold it."""
        if not len(x):
            return []
        largest = self.rows * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, self.sums))
        if largest < 1 << 62:
            away = self.rows * x - np.array(self.sums, dtype=np.int64)
            if max(abs(int(away.max())), abs(int(away.min()))) ** 2 * x.shape[1] < 1 << 63:
                return (away * away).sum(axis=1).tolist()
            away = away.astype(object)
        else:
            away = self.rows * x.astype(object) - np.array(self.sums, dtype=object)
        return [int(d) if d < 1 << 63 else None for d in (away * away).sum(axis=1)]


def fit(distinct: DataFrame, components: int = COMPONENTS, vector: str = "x") -> Whitening | None:
    """The whitening of a table of different integer vectors of one length; None if it is empty.

    Two passes: counts and exact sums, then the scatter about the means. Components without variance are left out, so
    there may be fewer than asked for; vectors that are all equal have none.
    """
    rows = distinct.select(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                found = exact_sums(matrix_of(batch.column(0)))
                count, sums = count + batch.num_rows, found if sums is None else [a + b for a, b in zip(sums, found)]
        whole = [count, *(sums or [])]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(whole)), pa.int32()), pa.array([str(s) for s in whole])], names=["i", "s"])

    parts = rows.mapInArrow(run, "i int, s string")
    count, *sums = [int(r["s"]) for r in parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()] or [0]
    if not count:
        return None
    model = Whitening(count, sums, np.empty(0), np.empty((len(sums), 0)), 0.0)
    scatter = product_sums(rows, model.centred, len(sums))
    values, vectors = jacobi(pivoted_cholesky((scatter + scatter.T) / 2))
    values = values / count
    model.trace = float(values.sum())
    model.values, model.components = values[:components], vectors[:, :components]
    return model


def identity_error(distinct: DataFrame, model: Whitening, vector: str = "x") -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity (0 without components)."""
    size = len(model.values)
    if not size:
        return 0.0

    def turned(x: np.ndarray) -> np.ndarray:
        return np.hstack([model.whitened(x), np.ones((len(x), 1))])

    sums = product_sums(distinct.select(vector), turned, size + 1)
    means = sums[-1, :-1] / model.rows
    covariance = sums[:-1, :-1] / model.rows - np.outer(means, means)
    return float(np.abs(covariance - np.eye(size)).max())


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, output: str = "whitening", scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, Whitening | None, float]:
    """The rows that take part with a struct ``output`` (deviation, whitened), the model and its identity error.

    Every entry c of a vector becomes the whole number floor(scale * c) + shift. The model is fitted on every different
    integer vector once, so repeated rows weigh nothing, and is applied to all rows; equal rows get equal results. Rows
    left out are named at ``integer_rows``. ``deviation`` is null where a long does not hold it. A column named
    ``output`` is replaced; without rows the model is None.
    """
    source = df.select(*[c for c in df.columns if c != output], F.col(vector).alias("__vector"))
    rows = integer_rows(source, "__vector", scale, shift, "__x")
    distinct = stored(rows.select(F.col("__x").alias("x")).distinct(), "distinct")
    model = fit(distinct, components)
    error = identity_error(distinct, model) if model else 0.0
    delete_stored(distinct)
    keep = [c for c in df.columns if c != output]
    k = len(keep)
    result = T.StructType([T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(output, result)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and model:
                x = matrix_of(batch.column(k))
                fields = [pa.array(model.deviations(x), pa.int64()), pa.array(list(model.whitened(x)), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.StructArray.from_arrays(fields, names=["deviation", "whitened"])], names=[*keep, output])

    return rows.select(*keep, "__x").mapInArrow(run, schema), model, error
