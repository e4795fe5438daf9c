"""k-means from many starts at once: one pass over the rows moves the centres of all of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlens.operators.knn import as_lists, matrix

#: Rows of least hash from which all starts are taken, and on which they are run first.
START_ROWS = 4096
#: Rows compared with all centres at a time.
CHUNK = 2048
#: Rows of a pass that one task takes; each is compared with the centres of all starts.
TASK_ROWS = 8192
#: A start is steady once no centre moves farther.
TOLERANCE = 1e-4


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre by row and start, for centres (starts, k, dimensions); ties go to the first."""
    starts, k, dims = centres.shape
    flat = centres.reshape(-1, dims)
    middle = flat.mean(axis=0)  # products of values near zero keep their digits
    flat = flat - middle
    gaps = (flat**2).sum(axis=1) - 2 * ((x - middle) @ flat.T)
    return gaps.reshape(len(x), starts, k).argmin(axis=2)


def cluster_sums(parts: Iterable[np.ndarray], centres: np.ndarray) -> np.ndarray:
    """By start and cluster: rows, squared distances to the centre, and sums of the differences from it."""
    starts, k, dims = centres.shape
    sums = np.zeros((starts, k, dims + 2))
    for rows in parts:
        for at in range(0, len(rows), CHUNK):
            x = rows[at : at + CHUNK]
            labels = nearest_centres(x, centres).T
            # One start at a time, so that the differences stay in a core's cache.
            for own, near, added in zip(labels, centres, sums):
                away = x - near[own]
                added[:, 0] += np.bincount(own, minlength=k)
                added[:, 1] += np.bincount(own, (away**2).sum(axis=1), k)
                for d in range(dims):
                    added[:, 2 + d] += np.bincount(own, away[:, d], k)
    return sums


def pass_over(rows: DataFrame, vector: str, centres: np.ndarray) -> np.ndarray:
    """``cluster_sums`` over all rows, in one aggregation whose result is a few numbers per centre."""
    starts, k, dims = centres.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = cluster_sums((matrix(b.column(0)) for b in batches if b.num_rows), centres).reshape(-1, dims + 2)
        used = np.flatnonzero(found[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), as_lists(found[used])], names=["place", "sums"])

    per_task = rows.select(vector).mapInArrow(sums, "place int, sums array<double>")
    added = per_task.groupBy("place").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(dims + 2)]).alias("sums"))
    total = np.zeros((starts * k, dims + 2))
    for row in added.collect():
        total[row["place"]] = row["sums"]
    return total.reshape(starts, k, dims + 2)


def moved(centres: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The means of the clusters; a centre without rows stays where it is."""
    counts = sums[:, :, :1]
    return centres + np.divide(sums[:, :, 2:], counts, out=np.zeros_like(centres), where=counts > 0)


def spread_starts(x: np.ndarray, k: int, starts: int, seed: int) -> np.ndarray:
    """k-means++ draws; with fewer different rows there are fewer centres, in every start as many."""
    k = min(k, len(np.unique(x, axis=0)))
    found = []
    for start in range(starts):
        draw = np.random.default_rng([seed, start])
        chosen = [x[draw.integers(len(x))]]
        gap = ((x - chosen[0]) ** 2).sum(axis=1)
        while len(chosen) < k:
            chosen.append(x[draw.choice(len(x), p=gap / gap.sum())])
            gap = np.minimum(gap, ((x - chosen[-1]) ** 2).sum(axis=1))
        found.append(chosen)
    return np.array(found)


def _until_steady(centres: np.ndarray, look, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd steps of the starts that still move, at most ``max_iter``; the centres and their costs."""
    centres, costs = centres.copy(), np.full(len(centres), np.inf)
    moving = np.arange(len(centres))
    for step in range(max_iter + 1):
        sums = look(centres[moving])
        costs[moving] = sums[:, :, 1].sum(axis=1)
        after = moved(centres[moving], sums)
        far = ((after - centres[moving]) ** 2).sum(axis=2).max(axis=1) > TOLERANCE**2
        if step == max_iter or not far.any():
            break
        moving = moving[far]
        centres[moving] = after[far]
    return centres, costs


def fit_centres(rows: DataFrame, vector: str, k: int, starts: int, max_iter: int = 50, seed: int = 123) -> tuple[np.ndarray, float]:
    """The centres of least cost of all starts, ordered by their coordinates, and that cost; persist the rows before.

    ``vector`` is an array of doubles. All starts are drawn from the START_ROWS rows of least hash and made steady on these;
    then every pass moves the centres of all starts over the whole table, and steady ones drop out, so that a table of that
    size takes one pass. The choice of rows doesn't depend on partitions. A table without rows and vectors with null or
    non-finite entries raise.
    """
    if starts < 1:
        raise ValueError("at least one start is needed")
    sample = rows.select(vector).orderBy(F.xxhash64(F.lit(seed), vector), vector).limit(START_ROWS).collect()
    if not sample:
        raise ValueError("no rows to fit on")
    unfit = rows.filter(F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    if unfit.limit(1).count():
        raise ValueError("vectors must be finite")
    x = np.array([r[0] for r in sample], dtype=float)
    centres, _ = _until_steady(spread_starts(x, k, starts, seed), lambda c: cluster_sums([x], c), max_iter)
    # Starts that came to the same centres are one.
    ordered = np.array([sorted(c.tolist()) for c in centres])
    centres, costs = _until_steady(np.unique(ordered, axis=0), lambda c: pass_over(rows, vector, c), max_iter)
    best = int(costs.argmin())
    return np.array(sorted(centres[best].tolist())), float(costs[best])
