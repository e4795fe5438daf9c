"""Exact nearest neighbours as a distributed join, and the outlier detector built on it.

Equal vectors are first merged into one with a number of copies, so that no group of copies
reaches a single task. The distinct reference vectors are split into blocks of bounded size by a
k-d tree over a sample; neighbouring blocks travel together as an area. A query first meets its home
area, which bounds its k-th distance; then only areas with a block whose bounding box lies within that
bound. Inside a task, nearer blocks come first and lower the bound, and a screen rules out most pairs of
a block. The sample decides how even the blocks are, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from loginlens.functions.quantile import exact_quantile
from loginlens.operators.detector import VECTOR, Detector, DetectorModel
from loginlens.operators.distances import PIECE, Metric, build_metric, screened
from loginlens.schema import with_field
from loginlens.session import materialise

BLOCK_ROWS = 1024  # reference vectors per block
SINGLE_ROWS = 8 * BLOCK_ROWS  # up to here one block is enough
CHUNK_ROWS = 2048  # queries that meet a block in one task
MOST_AREA = 32  # blocks that travel together; fewer in small tables, so that there are some areas for each task
AREAS = 16
MAX_BLOCKS = 20_000  # beyond this, blocks grow instead
SAMPLE_PER_BLOCK = 32
STEP_ROWS = 256  # queries compared at once
FEW_BOXES = 32  # boxes in one larger box, where areas are looked for
COUNTED_DIMS = 8  # Hamming distances of up to so many coordinates are counted
HOT_COPIES = 1_000_000  # copies from which a vector is joined by broadcast
NEAR = "array<struct<distance:double,ref_id:bigint,copies:bigint>>"


@dataclass(frozen=True)
class Space:
    """A metric by name, with the scale matrix some metrics need."""

    metric: str = "minkowski"
    scale: list[list[float]] | None = None

    def build(self):
        return build_metric(self.metric, None if self.scale is None else np.array(self.scale))


def fit_space(df: DataFrame, vector: str, metric: str) -> Space:
    """The space for a metric, with the spread of the given rows where the metric uses it."""
    if metric not in ("seuclidean", "mahalanobis"):
        return Space(metric)
    dims = df.select(F.size(vector).alias("d")).first()["d"]
    spread = df.agg(*[F.stddev_samp(F.get(vector, F.lit(j))).alias(f"s{j}") for j in range(dims)]).first()
    sd = np.array([s or 0.0 for s in spread])
    if metric == "seuclidean":
        return Space(metric, np.diag(np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)).tolist())
    correlation = Correlation.corr(df.select(array_to_vector(vector).alias("v")), "v").first()[0].toArray()
    covariance = np.nan_to_num(correlation) * np.outer(sd, sd)
    values, vectors = np.linalg.eigh(covariance)
    keep = values > values.max() * 1e-12
    return Space(metric, (vectors[:, keep] / np.sqrt(values[keep])).tolist())


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrow list column as a (rows x dimensions) array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def as_lists(rows: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))


def in_space(df: DataFrame, vector: str, space: Space) -> DataFrame:
    """Vectors as the metric compares them (unit length, 0/1, scaled, …)."""
    if space.scale is None and space.metric not in ("cosine", "correlation") and _is_plain(space.metric):
        return df
    others = [c for c in df.columns if c != vector]

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        metric = space.build()
        for batch in batches:
            if batch.num_rows:
                ready = as_lists(metric.prepare(matrix(batch.column(vector))))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], ready], [*others, vector])

    return df.select(*others, vector).mapInArrow(prepare, df.select(*others, vector).schema)


def _is_plain(metric: str) -> bool:
    probe = np.array([[2.0, 3.0]])
    return bool((build_metric(metric).prepare(probe) == probe).all())


def distinct_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Distinct vectors as (vec_id, vector, copies), checkpointed so that the ids stay."""
    merged = df.groupBy(F.col(vector).alias("vector")).agg(F.count("*").alias("copies"))
    return materialise(merged.select(F.monotonically_increasing_id().alias("vec_id"), "vector", "copies"))


def join_by_vector(rows: DataFrame, per_vector: DataFrame, vector: str, hot: int = HOT_COPIES) -> DataFrame:
    """Columns of distinct vectors (vector, copies, …) back on the rows that have them.

    A vector with very many copies would send all its rows to one task. Such vectors are few, at
    most the number of rows over ``hot``, so they are broadcast and only the other rows shuffle.
    """
    values = [c for c in per_vector.columns if c not in ("vector", "copies")]
    side = per_vector.select(F.col("vector").alias(vector), "copies", *values)
    most = per_vector.agg(F.max("copies")).first()[0] or 0
    if most <= hot:
        return rows.join(side.drop("copies"), vector)
    common = F.broadcast(side.filter(F.col("copies") > hot).select(F.col(vector).alias("_common"), *values))
    marked = rows.join(common, F.col(vector) == F.col("_common"), "left")
    rest = marked.filter(F.col("_common").isNull()).drop("_common", *values)
    cold = side.filter(F.col("copies") <= hot).drop("copies")
    return marked.filter(F.col("_common").isNotNull()).drop("_common").unionByName(rest.join(cold, vector))


@dataclass
class Tree:
    """k-d tree as arrays: split dimension (-1 = leaf), threshold, children or leaf number."""

    dim: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int

    @classmethod
    def build(cls, points: np.ndarray, per_leaf: float) -> "Tree":
        dim, threshold, left, right = [-1], [0.0], [0], [0]
        leaves, open_nodes = 0, [(0, np.arange(len(points)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            inside = points[rows]
            spread = inside.max(axis=0) - inside.min(axis=0) if len(rows) else np.zeros(1)
            if len(rows) <= max(per_leaf, 1) or spread.max() <= 0:
                left[node], leaves = leaves, leaves + 1
                continue
            j = int(spread.argmax())
            values = inside[:, j]
            cut = float(np.median(values))
            if cut >= values.max():
                cut = float(values[values < values.max()].max())
            below = values <= cut
            dim[node], threshold[node] = j, cut
            for side, part in ((left, rows[below]), (right, rows[~below])):
                side[node] = len(dim)
                open_nodes.append((len(dim), part))
                for column, start in ((dim, -1), (threshold, 0.0), (left, 0), (right, 0)):
                    column.append(start)
        return cls(np.array(dim), np.array(threshold), np.array(left), np.array(right), leaves)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.dim[node] >= 0)
            if not len(inner):
                return self.left[node]
            at = node[inner]
            below = points[inner, self.dim[at]] <= self.threshold[at]
            node[inner] = np.where(below, self.left[at], self.right[at])


class Blocks:
    """Reference vectors in blocks of bounded size, with the bounding box of each."""

    def __init__(self, refs: DataFrame, block_rows: int = BLOCK_ROWS) -> None:
        self.rows = refs.count()
        dims = refs.select(F.size("vector").alias("d")).first()
        self.dims = dims["d"] if dims else 0
        self.single = self.rows <= SINGLE_ROWS * block_rows // BLOCK_ROWS
        block_rows = max(block_rows, math.ceil(self.rows / MAX_BLOCKS))
        wanted = SAMPLE_PER_BLOCK * math.ceil(self.rows / block_rows)
        self.per_area, self.chunk_rows = 1, CHUNK_ROWS
        if self.single:
            self.table = self.place(refs)
            return
        sample = refs.sample(min(1.0, 1.2 * max(wanted, 4096) / self.rows), seed=7).select("vector").toArrow()
        points = matrix(sample.column("vector"))
        self.tree = Tree.build(points, block_rows * len(points) / self.rows)
        self._number(np.ones(self.tree.leaves, dtype=np.int64))
        sizes = self.place(refs, "ref_id").groupBy("block").count().collect()
        per_leaf = np.zeros(self.tree.leaves)
        for row in sizes:
            per_leaf[row["block"]] = row["count"]
        # A leaf the sample missed is cut by id: same box, bounded size.
        self._number(np.maximum(1, np.ceil(per_leaf / (2 * block_rows))).astype(np.int64))
        self.table = materialise(self.place(refs, "ref_id"))
        boxes = self.table.groupBy("block").agg(
            *[F.min(F.get("vector", F.lit(j))).alias(f"lo{j}") for j in range(self.dims)],
            *[F.max(F.get("vector", F.lit(j))).alias(f"hi{j}") for j in range(self.dims)],
        ).collect()
        total = int(self.starts[-1] + self.splits[-1])
        self.per_area = max(1, min(MOST_AREA, max(total // AREAS, min(8, total // 4))))
        self.chunk_rows = max(CHUNK_ROWS, self.per_area * block_rows)
        self.low = np.full((total, self.dims), np.inf)
        self.high = np.full((total, self.dims), -np.inf)
        for row in boxes:
            self.low[row["block"]] = row[1 : 1 + self.dims]
            self.high[row["block"]] = row[1 + self.dims :]

    def area(self, block: Column) -> Column:
        """Blocks of neighbouring leaves have neighbouring numbers."""
        return F.floor(block / self.per_area).cast("long")

    def _number(self, splits: np.ndarray) -> None:
        self.splits = splits
        self.starts = np.concatenate([[0], np.cumsum(splits)[:-1]])

    def place(self, df: DataFrame, spread_by: str | None = None) -> DataFrame:
        """Add the block a vector falls into; queries take the first block of their leaf."""
        if self.single:
            return df.withColumn("block", F.lit(0).cast("long"))
        tree, starts, splits = self.tree, self.starts, self.splits
        names = df.columns

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                leaf = tree.leaf_of(matrix(batch.column("vector")))
                block = starts[leaf]
                if spread_by:
                    block = block + batch.column(spread_by).to_numpy() % splits[leaf]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], [*names, "block"])

        return df.mapInArrow(assign, with_field(df.schema, "block", T.LongType()))


class Found:
    """The up to k nearest references met so far by some queries; ``limit`` is the distance beyond which none counts."""

    def __init__(self, limit: np.ndarray, k: int) -> None:
        self.limit, self.k, self.waiting = limit.copy(), k, 0
        self.parts = [(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]

    def add(self, row: np.ndarray, value: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        near = value <= self.limit[row]
        self.parts.append((row[near], value[near], ids[near], at[near]))
        self.waiting += int(near.sum())
        if self.waiting > 2 * self.k * len(self.limit):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        row, value, ids, at = (np.concatenate(p) for p in zip(*self.parts))
        order = np.lexsort((ids, value, row))
        row, value, ids, at = row[order], value[order], ids[order], at[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(self.limit)))[row]
        last = place == self.k - 1
        self.limit[row[last]] = np.minimum(self.limit[row[last]], value[last])
        keep = place < self.k
        self.parts, self.waiting = [(row[keep], value[keep], ids[keep], at[keep])], 0
        return self.parts[0]


def _least(metric: Metric, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least distance of every query to every box, with room for rounding between it and the distance itself."""
    return metric.bound(q, low, high) * (1 - 1e-9) - 1e-12


def box_levels(low: np.ndarray, high: np.ndarray, many: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The boxes in the last place; before them boxes around ``many`` neighbouring ones each, until there are few."""
    levels = [(low, high)]
    while len(levels[0][0]) > many:
        starts = np.arange(0, len(levels[0][0]), many)
        levels.insert(0, (np.minimum.reduceat(levels[0][0], starts, axis=0), np.maximum.reduceat(levels[0][1], starts, axis=0)))
    return levels


def boxes_within(metric: Metric, q: np.ndarray, bound: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], many: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of boxes, in order, and which of them may hold a vector within the bound of which query.

    Boxes inside a larger one that lies beyond every bound are left out, so queries near each other look at few.
    """
    some = np.arange(len(levels[0][0]))
    for i, (low, high) in enumerate(levels):
        near = ~(_least(metric, q, low[some], high[some]) > bound[:, None])
        if i + 1 < len(levels):
            some = (some[near.any(axis=0)][:, None] * many + np.arange(many)).ravel()
            some = some[some < len(levels[i + 1][0])]
    return some, near


def _nearest(space: Space, k: int, queries: pa.Table, refs: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Per query the up to k nearest of some references within the query's bound.

    References may name their ``ref_block``; those of one block are compared together. Queries are compared in steps of
    STEP_ROWS, so neighbouring ones should follow each other.
    """
    metric = space.build()
    if "ref_block" in refs.column_names:
        refs = refs.take(np.argsort(refs.column("ref_block").to_numpy(), kind="stable"))
    ids, copies = refs.column("ref_id").to_numpy(), refs.column("copies").to_numpy()
    r, q = matrix(refs.column("ref_vector")), matrix(queries.column("vector"))
    limits = queries.column("bound").to_numpy()
    block = refs.column("ref_block").to_numpy() if "ref_block" in refs.column_names else np.zeros(len(r), dtype=np.int64)
    begins = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1])
    begins = np.concatenate([np.arange(a, b, BLOCK_ROWS) for a, b in zip(begins, [*begins[1:], len(r)])])
    ends = np.concatenate([begins[1:], [len(r)]])
    low, high = np.minimum.reduceat(r, begins, axis=0), np.maximum.reduceat(r, begins, axis=0)
    first = max(4 * k, 64)  # compared in full, to have a limit
    piece = max(PIECE, PIECE * 64 // max(1, q.shape[1]))  # about as many numbers, whatever the coordinates
    screen = metric.screen(r) if metric.screen and len(r) > first and screened(r) and screened(q) else None
    sizes, parts = [], []
    for start in range(0, len(q), STEP_ROWS):
        some = q[start : start + STEP_ROWS]
        found = Found(limits[start : start + STEP_ROWS], k)
        look = screen(some) if screen else None
        least = _least(metric, some, low, high)
        for b in np.argsort(least.min(axis=0), kind="stable"):
            asked = np.flatnonzero(~(least[:, b] > found.limit))
            if not len(asked):
                continue
            begin, end = int(begins[b]), int(ends[b])
            until = end if look is None else begin
            if look and np.isinf(found.limit[asked]).any():
                until = min(begin + first, end)
            if until > begin:
                d = metric.pairs(some[asked], r[begin:until])
                limit = found.limit[asked]
                if d.shape[1] > k:
                    limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
                row, col = np.nonzero(d <= limit[:, None])
                found.add(asked[row], d[row, col], ids[begin + col], begin + col)
                found.settle()
            if until < end:
                row, col = np.nonzero(look(asked, until, end, found.limit[asked]))
                for i in range(0, len(row), piece):
                    own, col_ = asked[row[i : i + piece]], until + col[i : i + piece]
                    if metric.rough:
                        near = ~(metric.rough(some[own], r[col_]) > found.limit[own] * (1 + 1e-9) + 1e-300)
                        own, col_ = own[near], col_[near]
                    found.add(own, metric.rows(some[own], r[col_]), ids[col_], col_)
        row, value, own, at = found.settle()
        sizes.append(np.bincount(row, minlength=len(some)))
        parts.append((value, own, copies[at]))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
    flat = [np.concatenate([p[i] for p in parts]) for i in range(3)]
    struct = pa.StructArray.from_arrays([pa.array(x) for x in flat], ["distance", "ref_id", "copies"])
    return np.diff(offsets), pa.ListArray.from_arrays(offsets, struct)


def _meet(visits: DataFrame, blocks: Blocks, k: int, space: Space) -> DataFrame:
    """Compare every query with the area it visits: rows (query_id, vector, block, near).

    An area many queries visit is sent to several tasks, each with a part of the queries.
    """
    busy = visits.groupBy("area").agg(F.ceil(F.count("*") / F.lit(blocks.chunk_rows)).cast("int").alias("chunks"))
    busy = F.broadcast(busy)  # one row per area, at most MAX_BLOCKS and the splits of uneven leaves
    asked = visits.join(busy, "area").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
    placed = blocks.table.withColumn("area", blocks.area(F.col("block")))
    offered = placed.join(busy, "area").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def compare(queries: pa.Table, refs: pa.Table) -> pa.Table:
        if not queries.num_rows or not refs.num_rows:
            return empty.slice(0, 0)
        queries = queries.take(np.argsort(queries.column("block").to_numpy(), kind="stable"))
        _, near = _nearest(space, k, queries, refs)
        return pa.table(
            {
                "query_id": queries.column("query_id"),
                "vector": queries.column("vector"),
                "block": queries.column("block"),
                "near": near,
            }
        )

    near_type = pa.list_(pa.struct([("distance", pa.float64()), ("ref_id", pa.int64()), ("copies", pa.int64())]))
    empty = pa.table(
        {
            "query_id": pa.array([], pa.int64()),
            "vector": pa.array([], pa.list_(pa.float64())),
            "block": pa.array([], pa.int64()),
            "near": pa.array([], near_type),
        }
    )
    left = asked.select("query_id", "vector", "block", "bound", "area", "chunk").groupBy("area", "chunk")
    right = offered.select(
        "ref_id", F.col("vector").alias("ref_vector"), "copies", F.col("block").alias("ref_block"), F.col("area").alias("to"), F.col("chunk").alias("part")
    ).groupBy("to", "part")
    return left.cogroup(right).applyInArrow(compare, f"query_id bigint, vector array<double>, block bigint, near {NEAR}")


def distances(near: Column, k: int) -> Column:
    """The k smallest distances, copies counted one by one."""
    repeated = F.transform(near, lambda c: F.array_repeat(c["distance"], F.least(c["copies"], F.lit(k)).cast("int")))
    return F.slice(F.flatten(repeated), 1, k)


def knn_search(
    queries: DataFrame, refs: DataFrame, k: int, space: Space = Space(), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """For distinct query vectors (query_id, vector) the nearest reference vectors.

    ``refs`` has (ref_id, vector, copies) with distinct vectors. Returns (query_id, near): the
    nearest references in order, enough of them to cover k copies.
    """
    blocks = Blocks(refs, block_rows)
    home = blocks.place(queries.select("query_id", "vector")).withColumn("bound", F.lit(float("inf")))
    home = home.withColumn("area", blocks.area(F.col("block")))
    if blocks.single:
        return _meet(home, blocks, k, space).select("query_id", "near")
    first = materialise(_meet(home, blocks, k, space))
    levels, per_area = box_levels(blocks.low, blocks.high, FEW_BOXES), blocks.per_area

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        metric = space.build()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                q, bound = matrix(part.column("vector")), part.column("bound").to_numpy()
                some, near = boxes_within(metric, q, bound, levels, FEW_BOXES)
                area, begins = np.unique(some // per_area, return_index=True)
                wanted = np.logical_or.reduceat(near, begins, axis=1) if len(area) else near
                wanted = wanted & (area != part.column("block").to_numpy()[:, None] // per_area)
                row, at_area = np.nonzero(wanted)
                offsets = np.searchsorted(row, np.arange(len(q) + 1)).astype(np.int32)
                areas = pa.ListArray.from_arrays(offsets, pa.array(area[at_area].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, areas], [*part.schema.names, "areas"])

    near_k = distances(F.col("near"), k)
    bound = F.when(F.size(near_k) >= k, F.element_at(near_k, k)).otherwise(F.lit(float("inf")))
    asked = first.select("query_id", "vector", "block", bound.alias("bound"))
    asked = materialise(asked.mapInArrow(others, "query_id bigint, vector array<double>, block bigint, bound double, areas array<bigint>"))
    visits = asked.withColumn("area", F.explode("areas")).drop("areas")
    rest = _meet(visits, blocks, k, space).filter(F.size("near") > 0)
    found = first.select("query_id", "near").unionByName(rest.select("query_id", "near"))
    merged = F.array_sort(F.flatten(F.collect_list("near")))
    return found.groupBy("query_id").agg(F.slice(merged, 1, k).alias("near"))


def hamming_distances(queries: DataFrame, refs: DataFrame, dims: int) -> DataFrame:
    """For query vectors (query_id, vector) how many references lie at each Hamming distance: rows (query_id, near).

    ``near`` has one entry for each distance that occurs, with no ``ref_id``. References are counted by their values in
    every set of coordinates; the sums of a query's counts over the sets of one size say how many references agree with it
    in exactly so many coordinates, by inclusion and exclusion. No two vectors are compared, so the work grows with their
    number. A coordinate without a number agrees with none. The counts are joined by shuffle: Spark's estimate leaves out
    the many sets of every row, so it would broadcast them by way of the driver.
    """
    total = refs.agg(F.sum("copies")).first()[0] or 0
    values = [F.get("vector", F.lit(j)).cast("double") + 0.0 for j in range(dims)]
    missing = [F.when(v.isNull() | F.isnan(v), 1 << j).otherwise(0) for j, v in enumerate(values)]

    def by_set(df: DataFrame, *columns: str) -> DataFrame:
        sets = df.select(*columns, "vector", sum(missing, F.lit(0)).alias("missing"), F.explode(F.sequence(F.lit(1), F.lit((1 << dims) - 1))).alias("set"))
        own = F.array(*[F.when(F.col("set").bitwiseAND(F.lit(1 << j)) != 0, v) for j, v in enumerate(values)])
        return sets.filter(F.col("set").bitwiseAND(F.col("missing")) == 0).select(*columns, "set", own.alias("values"))

    counted = materialise(by_set(refs, "copies").groupBy("set", "values").agg(F.sum("copies").alias("n")))
    met = by_set(queries, "query_id").join(counted.hint("merge"), ["set", "values"])
    sums = met.groupBy("query_id").agg(*[F.sum(F.when(F.bit_count("set") == m, F.col("n"))).alias(f"s{m}") for m in range(1, dims + 1)])
    summed = [F.lit(total), *[F.coalesce(f"s{m}", F.lit(0)) for m in range(1, dims + 1)]]
    agree = [sum((summed[m] * ((-1) ** (m - j) * math.comb(m, j)) for m in range(j, dims + 1)), F.lit(0)) for j in range(dims + 1)]
    near = F.array(*[F.struct(F.lit((dims - j) / dims).alias("distance"), F.lit(None).cast("long").alias("ref_id"), agree[j].cast("long").alias("copies")) for j in range(dims, -1, -1)])
    return queries.select("query_id").join(sums, "query_id", "left").select("query_id", F.filter(near, lambda c: c["copies"] > 0).alias("near"))


def neighbour_score(values: Column, method: str) -> Column:
    """One number from the sorted distances of a row."""
    n = F.size(values)
    if method == "largest":
        return F.element_at(values, -1)
    if method == "mean":
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / n
    if method == "median":
        half = F.floor((n + 1) / 2).cast("int")
        return (F.element_at(values, half) + F.element_at(values, n + 1 - half)) / 2
    raise ValueError("method must be largest, mean or median")


def knn_pairs(df: DataFrame, key: str, vector: str, k: int, metric: str = "minkowski") -> DataFrame:
    """The k nearest other rows of every row as (key, neighbour, distance, place).

    Rows of equal vectors are neighbours at distance 0. Of equally distant rows the smaller keys
    come first.
    """
    space = fit_space(df, vector, metric)
    rows = in_space(df.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("vector")), "vector", space)
    vecs = distinct_vectors(rows, "vector")
    near = knn_search(
        vecs.select(F.col("vec_id").alias("query_id"), "vector"),
        vecs.select(F.col("vec_id").alias("ref_id"), "vector", "copies"),
        k + 1,
        space,
    )
    owned = join_by_vector(rows, vecs, "vector").select("_key", "vec_id")
    # At most k+1 rows of one vector can be among anyone's neighbours.
    order = Window.partitionBy("vec_id").orderBy("_key")
    members = owned.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
    listed = members.groupBy("vec_id").agg(F.collect_list("_key").alias("keys"))
    spread = near.select("query_id", F.explode("near").alias("c")).select("query_id", "c.distance", "c.ref_id")
    options = spread.join(listed.withColumnRenamed("vec_id", "ref_id"), "ref_id").select(
        "query_id", F.transform("keys", lambda x: F.struct(F.col("distance"), x.alias("neighbour"))).alias("options")
    )
    per_vector = options.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("options"))), 1, k + 1).alias("near"))
    per_row = owned.join(per_vector, owned["vec_id"] == per_vector["query_id"]).select(
        F.col("_key").alias(key),
        F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("_key")), 1, k).alias("near"),
    )
    exploded = per_row.select(key, F.posexplode("near").alias("place", "c"))
    return exploded.select(key, F.col("c.neighbour").alias("neighbour"), F.col("c.distance").alias("distance"), (F.col("place") + 1).alias("place"))


class KNNParams(Params):
    n_neighbors = Param(Params._dummy(), "n_neighbors", "number of neighbours", TypeConverters.toInt)
    method = Param(Params._dummy(), "method", "largest, mean or median distance", TypeConverters.toString)
    metric = Param(Params._dummy(), "metric", "distance metric", TypeConverters.toString)
    include_self = Param(Params._dummy(), "include_self", "count a training row as its own neighbour", TypeConverters.toBoolean)
    approximate_above = Param(Params._dummy(), "approximate_above", "distinct reference vectors above which the search is approximate (0: never)", TypeConverters.toInt)

    def search(self, queries: DataFrame, refs: DataFrame, k: int, space: Space) -> DataFrame:
        """The exact search, or above a limit the approximate one, for metrics that have it.

        Few coordinates need no search for Hamming distances: these are counted.
        """
        from loginlens.operators.lsh import METRICS, approximate_knn_search

        limit = self.getOrDefault(self.approximate_above) if self.isDefined(self.approximate_above) else 0
        if limit and space.metric in METRICS and refs.count() > limit:
            return approximate_knn_search(queries, refs, k, space)
        if space.metric == "hamming":
            first = refs.select(F.size("vector").alias("d")).first()
            if first and 0 < first["d"] <= COUNTED_DIMS:
                return hamming_distances(queries, refs, first["d"])
        return knn_search(queries, refs, k, space)


class KNNDetector(Detector, KNNParams):
    """Outlier score from the distances to the nearest rows.

    The threshold is taken from training scores that leave the row itself out; a training row that
    is scored again finds itself at distance 0, unless ``include_self`` is off.
    """

    kind = "kNN"

    @classmethod
    def defaults(cls) -> dict[str, Any]:
        return {"contamination": 0.0001, "n_neighbors": 20, "method": "mean", "metric": "minkowski", "include_self": True, "approximate_above": 0}

    def _fit(self, df: DataFrame) -> "KNNModel":
        return self._learn(df)[0]

    def _learn(self, df: DataFrame) -> tuple["KNNModel", DataFrame]:
        k, how = self.value("n_neighbors"), self.value("method")
        rows = self.with_vector(df)
        space = fit_space(rows, VECTOR, self.value("metric"))
        vecs = distinct_vectors(in_space(rows.select(VECTOR), VECTOR, space), VECTOR)
        refs = vecs.select(F.col("vec_id").alias("ref_id"), "vector", "copies")
        near = self.search(vecs.select(F.col("vec_id").alias("query_id"), "vector"), refs, k + 1, space)
        listed = distances(F.col("near"), k + 1)
        others, own = F.slice(listed, 2, k), F.slice(listed, 1, k)
        scores = near.select(
            F.col("query_id").alias("vec_id"),
            neighbour_score(others, how).alias("others"),
            neighbour_score(own if self.value("include_self") else others, how).alias("scores"),
        )
        scored = materialise(vecs.join(scores, "vec_id").select("vector", "copies", "others", "scores"))
        border = exact_quantile(scored, "others", 1 - self.value("contamination"), weight="copies")
        model = KNNModel(self, self.columns_of(df), space, refs, border)
        return model, scored

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Fit and score the same rows with one neighbour search."""
        model, scored = self._learn(df)
        return model.attach(df, scored.select("vector", "copies", "scores"))


class KNNModel(DetectorModel, KNNParams):
    kind = "kNN"

    def __init__(self, detector: KNNDetector, columns: list[str], space: Space, refs: DataFrame, border: float) -> None:
        super().__init__()
        detector._copyValues(self)
        self.columns, self.space, self.refs, self.border = columns, space, refs, border

    def _transform(self, df: DataFrame) -> DataFrame:
        k = self.value("n_neighbors")
        rows = in_space(self.with_vector(df, self.columns).select(VECTOR), VECTOR, self.space)
        vecs = distinct_vectors(rows, VECTOR)
        near = self.search(vecs.select(F.col("vec_id").alias("query_id"), "vector"), self.refs, k, self.space)
        score = neighbour_score(distances(F.col("near"), k), self.value("method"))
        scores = vecs.join(near.select(F.col("query_id").alias("vec_id"), score.alias("scores")), "vec_id")
        return self.attach(df, scores.select("vector", "copies", "scores"))

    def attach(self, df: DataFrame, scores: DataFrame) -> DataFrame:
        """Scores of distinct vectors back on the rows."""
        rows = in_space(self.with_vector(df, self.columns), VECTOR, self.space)
        joined = join_by_vector(rows, scores, VECTOR)
        anomaly = (F.col("scores") > F.lit(self.border)).cast("int")
        return joined.select(*df.columns, "scores", anomaly.alias("anomaly"))

    def state(self) -> dict[str, Any]:
        return {"metric": self.space.metric, "scale": self.space.scale, "border": self.border}

    def tables(self) -> dict[str, DataFrame]:
        return {"reference": self.refs}

    def restore(self, state: dict[str, Any], read) -> None:
        self.space, self.border = Space(state["metric"], state["scale"]), state["border"]
        self.refs = read("reference")
