"""Approximate nearest neighbours through a few stable projections, a kd-tree and a chi-square stopping test.

The largest inner product is the least Euclidean distance once all vectors are lifted to one length. A Gaussian
projection to m dimensions keeps distances in the sense that the squared projected distance over the squared distance
follows a chi-square law with m degrees of freedom. So candidates are verified in the order of their projected
distance, until a point as near as the k-th best so far would, with the given confidence, have been seen already.

The upper levels of the kd-tree cut the rows into blocks; a query first meets the block that it lies in, whose k-th
distance then tells by the same test which other blocks it must visit. The lower levels are built inside the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loginlens.llm.common import stored

DIMENSIONS = 8
CONFIDENCE = 0.95
SEED = 11
BLOCK_ROWS = 4096
#: The upper tree is cut from a sample of about so many projected rows; every row is indexed.
SAMPLE_ROWS = 20_000
MOST_BLOCKS = 4096
LEAF_ROWS = 64
QUERIES_AT_ONCE = 128
#: Distances differ by rounding in less than this share of the squared lengths; rows so near to the last place are kept,
#: however many they are, until scores and ids settle it.
ROUNDING = 1e-11


def chi_square_quantile(p: float, degrees: int) -> float:
    """The value that a chi-square variable with an even number of degrees of freedom stays below with probability p."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))

    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


@dataclass
class UpperTree:
    """Cuts (axis, value) of a complete binary tree in heap order; the leaves are the blocks."""

    axes: np.ndarray
    values: np.ndarray
    depth: int

    def block_of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axes[node]] > self.values[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


def cut_tree(sample: np.ndarray, depth: int) -> UpperTree:
    """Median cuts along the axis of widest spread, from a sample of the projections."""
    size = (1 << depth) - 1
    axes, values = np.zeros(size, dtype=np.int64), np.zeros(size)
    parts = {0: sample}
    for node in range(size):
        rows = parts.pop(node)
        if len(rows):
            axes[node] = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            values[node] = np.median(rows[:, axes[node]])
            right = rows[:, axes[node]] > values[node]
            parts[2 * node + 1], parts[2 * node + 2] = rows[~right], rows[right]
        else:
            parts[2 * node + 1] = parts[2 * node + 2] = rows
    return UpperTree(axes, values, depth)


class Block:
    """The rows of one block with the lower levels of the kd-tree over their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lifted: np.ndarray, projected: np.ndarray):
        order = self._order(projected)
        self.ids, self.vectors, self.lifted, self.points = ids[order], vectors[order], lifted[order], projected[order]
        self.starts = np.arange(0, len(ids), LEAF_ROWS)
        self.low = np.minimum.reduceat(self.points, self.starts)
        self.high = np.maximum.reduceat(self.points, self.starts)
        spare = -len(ids) % LEAF_ROWS
        self.members = np.concatenate([np.arange(len(ids)), np.full(spare, -1)]).reshape(-1, LEAF_ROWS)

    @staticmethod
    def _order(points: np.ndarray) -> np.ndarray:
        """Rows in the order of the leaves of median cuts, every leaf full but the last."""
        done, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF_ROWS:
                done.append(rows)
                continue
            spread = points[rows].max(axis=0) - points[rows].min(axis=0)
            half = max(LEAF_ROWS, len(rows) // 2 // LEAF_ROWS * LEAF_ROWS)
            rows = rows[np.argpartition(points[rows, int(np.argmax(spread))], half - 1)]
            todo += [rows[half:], rows[:half]]
        return np.concatenate(done)

    def nearest(self, lifted: np.ndarray, projected: np.ndarray, limit: np.ndarray, k: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of the query, row, squared distance) of the k nearest found for each query and all that tie with the last.

        ``limit``: squared distance of the k-th best known from elsewhere. ``reach``: chi-square quantile of the test.
        The leaves nearest in projection are verified first; then the rows of all other leaves whose projected distance
        the test, with the k-th distance so far, still admits.
        """
        n = len(lifted)
        gaps = np.maximum(0, np.maximum(self.low[None] - projected[:, None], projected[:, None] - self.high[None]))
        away = (gaps**2).sum(axis=2)
        first = min(len(self.starts), -(-2 * k // LEAF_ROWS))
        rows = self.members[np.argpartition(away, first - 1, axis=1)[:, :first]].reshape(n, -1)
        apart = ((self.lifted[rows] - lifted[:, None]) ** 2).sum(axis=2)
        apart[rows < 0] = np.inf
        kth = np.partition(apart, k - 1, axis=1)[:, k - 1] if rows.shape[1] >= k else np.full(n, np.inf)
        border = np.minimum(kth, limit) * reach
        leaves = np.flatnonzero((away <= border[:, None]).any(axis=0))
        rows = self.members[leaves].ravel()
        rows = rows[rows >= 0]
        apart = self._distances(self.lifted[rows], lifted)
        apart[self._distances(self.points[rows], projected) > border[:, None]] = np.inf
        if len(rows) > k:
            last = np.partition(apart, k - 1, axis=1)[:, k - 1]
        else:
            last = np.full(n, np.inf)
        q, c = np.nonzero(np.isfinite(apart) & (apart <= (last + ROUNDING * (lifted**2).sum(axis=1))[:, None]))
        return q, rows[c], apart[q, c]

    @staticmethod
    def _distances(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        return np.maximum(0, (queries**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None] - 2 * queries @ rows.T)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) with doubles, without null keys, and without vectors that are null, zero or not all finite numbers."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def nearest_by_inner_product(
    df: DataFrame,
    queries: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    dimensions: int = DIMENSIONS,
    confidence: float = CONFIDENCE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, id, score): for each query row up to k other rows of ``df`` of largest inner product.

    The score is the double sum of products in order. Ties go to the smaller id; a query never meets rows with its own
    id. Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without id, nor
    vectors of another length than most have. With at most k candidates all of them are returned.

    Equal vectors are searched once: equal queries share one search, and of equal candidates only the k + 1 smallest ids
    can be an answer. The upper tree is cut from a bounded sample; the blocks' bounds cover every row.
    """
    spark = df.sparkSession
    result = "query_id long, rank int, id long, score double"
    rows = usable_vectors(df, key, vector)
    width = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    if not width:
        return spark.createDataFrame([], result)
    width = width[0]["w"]
    rows = rows.filter(F.size("v") == width)
    asked = usable_vectors(queries, key, vector).filter(F.size("v") == width)
    keep = Window.partitionBy("v").orderBy("id")
    rows = rows.dropDuplicates(["id", "v"]).withColumn("__n", F.row_number().over(keep)).filter(F.col("__n") <= k + 1).drop("__n")
    rows = stored(rows, "vectors")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = rows.agg(F.count("*").alias("n"), F.max(norm2).alias("m")).first()
    total, longest = stats["n"], stats["m"]
    random = np.random.default_rng(SEED)
    gaussian = random.normal(size=(width + 1, dimensions))
    depth = max(0, min(int(math.log2(MOST_BLOCKS)), math.ceil(math.log2(max(1, total / block_rows)))))

    def lift(v: np.ndarray, query: bool) -> np.ndarray:
        """All vectors get the length of the longest one: rows by one more coordinate, queries by a factor."""
        squares = (v**2).sum(axis=1)
        if query:
            return np.hstack([v * np.sqrt(longest / squares)[:, None], np.zeros((len(v), 1))])
        return np.hstack([v, np.sqrt(np.maximum(0, longest - squares))[:, None]])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(lift(_matrix(batch.column(1), width), False) @ gaussian), pa.list_(pa.float64()))], names=["p"])

    share = min(1.0, SAMPLE_ROWS / max(1, total))
    sampled = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(math.ceil(share * 1e6)))
    if depth:
        sample = np.array([r["p"] for r in sampled.mapInArrow(project, "p array<double>").collect()]).reshape(-1, dimensions)
        tree = cut_tree(sample, depth)
    else:
        tree = UpperTree(np.zeros(0, dtype=np.int64), np.zeros(0), 0)

    def place(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = lift(_matrix(batch.column(1), width), query) @ gaussian
                columns = [pa.array(tree.block_of(points)), batch.column(0), batch.column(1), pa.array(list(points), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "id", "v", "p"])

        return run

    schema = "block long, id long, v array<double>, p array<double>"
    indexed = stored(rows.mapInArrow(place(False), schema), "indexed")
    bounds = indexed.groupBy("block").agg(
        *[f(F.col("p")[i]).alias(f"{name}{i}") for i in range(dimensions) for name, f in (("lo", F.min), ("hi", F.max))]
    ).collect()
    blocks = np.array([b["block"] for b in bounds], dtype=np.int64)
    low = np.array([[b[f"lo{i}"] for i in range(dimensions)] for b in bounds])
    high = np.array([[b[f"hi{i}"] for i in range(dimensions)] for b in bounds])

    asked = stored(asked.select("id", "v"), "asked")
    distinct = asked.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")
    searches = stored(distinct.mapInArrow(place(True), schema), "searches")
    reach = chi_square_quantile(confidence, dimensions)
    found_rows = "query long, id long, score double, apart double"

    def visit(visits: DataFrame) -> DataFrame:
        """Search the blocks that the queries (block, id, v, p, limit) visit."""
        members = indexed.withColumn("limit", F.lit(-1.0))
        both = members.unionByName(visits.select(members.columns)).withColumn("asks", F.col("limit") >= 0)
        grouped = both.repartition("block").sortWithinPartitions("block", "asks").select("block", "asks", "id", "v", "p", "limit")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []
            current, block = None, None
            for batch in batches:
                numbers, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                    if lo == hi:
                        continue
                    part = batch.slice(lo, hi - lo)
                    if numbers[lo] != current:
                        current, block, held = numbers[lo], None, []
                    ids, v = part.column(2).to_numpy(), _matrix(part.column(3), width)
                    p, limit = _matrix(part.column(4), dimensions), part.column(5).to_numpy()
                    if not asks[lo]:
                        held.append((ids, v, lift(v, False), p))
                        continue
                    if not held:
                        continue
                    block = block or Block(*(np.concatenate(x) for x in zip(*held)))
                    for at in range(0, len(ids), QUERIES_AT_ONCE):
                        s = slice(at, at + QUERIES_AT_ONCE)
                        q, which, apart = block.nearest(lift(v[s], True), p[s], limit[s], k + 1, reach)
                        if not len(q):
                            continue
                        score = np.cumsum(v[s][q] * block.vectors[which], axis=1)[:, -1]
                        # Scores and ids settle what is equal but for rounding; what is beyond the limit is no answer either.
                        order = np.lexsort((block.ids[which], -score, q))
                        first = np.searchsorted(q[order], q[order])
                        order = order[np.arange(len(order)) - first <= k]
                        order = order[apart[order] <= limit[s][q[order]] * (1 + 1e-9) + 1e-9 + ROUNDING * longest]
                        columns = [x[order] for x in (ids[s][q], block.ids[which], score, apart)]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query", "id", "score", "apart"])

        return grouped.mapInArrow(run, found_rows)

    far = F.lit(1e300)
    home = stored(visit(searches.withColumn("limit", far)), "home")
    place_in_list = Window.partitionBy("query").orderBy("apart", "id")
    limits = home.withColumn("__n", F.row_number().over(place_in_list)).filter(F.col("__n") == k + 1).select(F.col("query").alias("id"), F.col("apart").alias("limit"))
    # A block with fewer rows gives no limit: such a query visits all blocks.
    bounded = searches.join(limits, "id", "left").select("id", "v", "p", F.coalesce("limit", far).alias("limit"), F.col("block").alias("home"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, limit, homes = _matrix(batch.column(2), dimensions), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            for at in range(0, batch.num_rows, 64):
                part = p[at : at + 64, None]
                gaps = np.maximum(0, np.maximum(low[None] - part, part - high[None]))
                go = ((gaps**2).sum(axis=2) <= limit[at : at + 64, None] * reach) & (blocks[None] != homes[at : at + 64, None])
                q, b = np.nonzero(go)
                taken = pa.array(q + at)
                columns = [pa.array(blocks[b]), *(batch.column(i).take(taken) for i in range(4))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "id", "v", "p", "limit"])

    away = visit(bounded.mapInArrow(others, "block long, id long, v array<double>, p array<double>, limit double"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    lists = home.select("query", "id", "score").unionByName(away.select("query", "id", "score"))
    lists = stored(lists.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= k + 1).drop("__n"), "lists")
    twins = stored(asked.join(distinct.select("v", F.col("id").alias("query")), "v").select(F.col("id").alias("query_id"), "query").distinct(), "twins")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    answers = twins.join(lists, "query").filter("id != query_id")
    return answers.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
