"""Gaussian mixtures by expectation maximisation, with a penalty on small variances.

Plain EM lets a component shrink onto one outlier, which then looks likely. Here the mean log density is reduced by
``penalty`` times the sum of the traces of the inverse covariances. The maximisation step stays in closed form: every
covariance gets ``2 * penalty * rows / weight of the component`` on its diagonal, little for a component of many rows,
much for one of a single row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlens.operators.knn import matrix

PENALTY = 1e-3
#: Rows of least hash from which the first components are taken.
START_ROWS = 4096
#: A component of less weight, in rows, is given up.
LEAST_WEIGHT = 1e-6


@dataclass
class Mixture:
    weights: list[float]
    means: list[list[float]]
    covariances: list[list[list[float]]]


def component_logs(
    z: np.ndarray, weights: Sequence[float], means: np.ndarray, covariances: np.ndarray, floor: float = 0.0
) -> np.ndarray:
    """log(weight * density) by component and row; ``floor`` is added to the diagonals."""
    z, dims = np.asarray(z, dtype=float), np.shape(z)[1]
    logs = np.full((len(weights), len(z)), -np.inf)
    for c, (weight, mean, covariance) in enumerate(zip(weights, means, covariances)):
        if weight > 0:
            factor = np.linalg.cholesky(np.asarray(covariance) + np.eye(dims) * floor)
            scaled = np.linalg.solve(factor, (z - mean).T)
            log_det = 2 * np.log(np.diag(factor)).sum()
            logs[c] = np.log(weight) - 0.5 * ((scaled**2).sum(axis=0) + dims * np.log(2 * np.pi) + log_det)
    return logs


def log_density(logs: np.ndarray) -> np.ndarray:
    """Log of the sum over components, so that far rows keep their differences."""
    top = logs.max(axis=0)
    return top + np.log(np.exp(logs - top).sum(axis=0))


def share_sums(parts: Iterator[np.ndarray], mixture: Mixture) -> np.ndarray:
    """Rows, log density, and by component the responsibilities, first and second moments about the old means, in one array."""
    old = np.array(mixture.means, dtype=float)
    k, d = old.shape
    ends, counts, firsts, seconds = np.zeros(2), np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
    for z in parts:
        logs = component_logs(z, mixture.weights, old, mixture.covariances)
        density = log_density(logs)
        shares = np.exp(logs - density)
        ends += [len(z), density.sum()]
        counts += shares.sum(axis=1)
        for c in range(k):
            away = z - old[c]
            weighed = away * shares[c][:, None]
            firsts[c] += weighed.sum(axis=0)
            seconds[c] += weighed.T @ away
    return np.concatenate([ends, counts, firsts.ravel(), seconds.ravel()])


def next_mixture(total: np.ndarray, mixture: Mixture, penalty: float) -> tuple[Mixture, float]:
    """The mixture after one step from the sums over all rows, and the penalised mean log density before it."""
    old = np.array(mixture.means, dtype=float)
    k, d = old.shape
    n, density = total[:2]
    counts, firsts, seconds = total[2 : 2 + k], total[2 + k : 2 + k + k * d].reshape(k, d), total[2 + k + k * d :].reshape(k, d, d)
    inverse = sum(np.trace(np.linalg.inv(np.array(s))) for w, s in zip(mixture.weights, mixture.covariances) if w > 0)
    weights, means, covariances = [], [], []
    for c in range(k):
        if counts[c] < LEAST_WEIGHT:
            weights.append(0.0)
            means.append(mixture.means[c])
            covariances.append(mixture.covariances[c])
            continue
        shift = firsts[c] / counts[c]
        covariance = seconds[c] / counts[c] - np.outer(shift, shift) + np.eye(d) * 2 * penalty * n / counts[c]
        weights.append(float(counts[c] / n))
        means.append((old[c] + shift).tolist())
        covariances.append(((covariance + covariance.T) / 2).tolist())
    return Mixture(weights, means, covariances), float(density / n - penalty * inverse)


def em_step(rows: DataFrame, vector: str, mixture: Mixture, penalty: float = PENALTY) -> tuple[Mixture, float]:
    """One step over all rows: the new mixture, and the penalised mean log density before it.

    Every partition adds up its rows, and the sums of these, a few numbers per component, are all that reaches the driver.
    A table without rows and vectors that are not finite raise.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = share_sums((matrix(b.column(0)) for b in batches if b.num_rows), mixture)
        if values[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["place", "value"])

    found = rows.select(vector).mapInArrow(sums, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.array([r["value"] for r in sorted(found.collect(), key=lambda r: r["place"])])
    if not len(total):
        raise ValueError("no rows to fit on")
    if not np.isfinite(total).all():
        raise ValueError("vectors must be finite")
    return next_mixture(total, mixture, penalty)


def first_mixture(
    rows: DataFrame, vector: str, components: int, penalty: float, seed: int, max_iter: int = 0, tolerance: float = 1e-4
) -> Mixture:
    """A start for EM from the START_ROWS rows of least hash: components around rows far from each other (k-means++), then
    at most ``max_iter`` steps over these rows alone.

    The choice does not depend on partitions. With fewer different rows there are fewer components.
    """
    sample = rows.select(vector).orderBy(F.xxhash64(F.lit(seed), vector), vector).limit(START_ROWS).collect()
    if not sample:
        raise ValueError("no rows to fit on")
    z = np.array([r[0] for r in sample], dtype=float)
    if not np.isfinite(z).all():
        raise ValueError("vectors must be finite")
    draw = np.random.default_rng(seed)
    centres = [z[draw.integers(len(z))]]
    gap = ((z - centres[0]) ** 2).sum(axis=1)
    while len(centres) < components and gap.sum() > 0:
        centres.append(z[draw.choice(len(z), p=gap / gap.sum())])
        gap = np.minimum(gap, ((z - centres[-1]) ** 2).sum(axis=1))
    means = np.array(centres)
    nearest = ((z[:, None, :] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
    share = np.bincount(nearest, minlength=len(means)) / len(z)
    spread = np.cov(z.T, bias=True).reshape(z.shape[1], -1) / len(means) + np.eye(z.shape[1]) * 2 * penalty * len(means)
    start = Mixture(share.tolist(), means.tolist(), [spread.tolist()] * len(means))
    return _until_steady(start, lambda m: next_mixture(share_sums(iter([z]), m), m, penalty), max_iter, tolerance)


def _until_steady(mixture: Mixture, step: Callable[[Mixture], tuple[Mixture, float]], max_iter: int, tolerance: float) -> Mixture:
    before = -np.inf
    for _ in range(max_iter):
        after, value = step(mixture)
        if value - before < tolerance:
            break
        mixture, before = after, value
    return mixture


def fit_mixture(
    rows: DataFrame, vector: str, components: int, penalty: float = PENALTY, max_iter: int = 300, tolerance: float = 1e-4, seed: int = 123
) -> Mixture:
    """Steps over all rows until the penalised mean log density gains less than ``tolerance``; persist the rows before.

    The bounded start is already steady on its own rows, so few passes over the table are left.
    """
    if penalty <= 0:
        raise ValueError("the penalty must be positive")
    start = first_mixture(rows, vector, components, penalty, seed, max_iter, tolerance)
    return _until_steady(start, lambda m: em_step(rows, vector, m, penalty), max_iter, tolerance)
