"""Approximate nearest neighbours for large tables: p-stable hash tables with multi-probe, then exact distances.

Every table cuts the space by random projections, each rounded to steps of one width; a reference vector lies in one
bucket of a table, a query also probes the buckets across its nearest borders. Queries and references meet in a join on
the bucket, and distances there are exact, so only neighbours that share no probed bucket are missed. The number of
projections, the width and the number of tables are chosen on some queries whose true neighbours are found by one pass
over all references, so that the recall asked for is met on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loginlens.operators.knn import NEAR, Space, _nearest, as_lists, knn_search, matrix
from loginlens.session import materialise

METRICS = ("euclidean", "l2", "minkowski", "seuclidean", "mahalanobis", "cosine")
PROBE_QUERIES = 256  # queries whose true neighbours settle the parameters
RANDOM_ROWS = 512  # references that tell how many rows share a bucket by chance
MOST_TABLES = 24
MOST_HASHES = 16
PROBES = 8
REACHES = (0.5, 0.9)  # quantiles of the distance of the k-th neighbour, which differ widely in uneven data
WIDTHS = (0.5, 1.0, 2.0, 4.0)  # steps, in these distances
BUCKET_ROWS = 2048  # references of a bucket that one task compares; larger buckets are split
QUERY_ROWS = 2048


@dataclass(frozen=True)
class HashTables:
    """``tables`` x ``hashes`` projections with offsets, and the multipliers that make a bucket's number."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float
    mixers: np.ndarray
    recall: float

    @staticmethod
    def draw(dims: int, tables: int, hashes: int, width: float, seed: int, recall: float = float("nan")) -> "HashTables":
        random = np.random.default_rng(seed)
        # Projections are drawn for the most tables and hashes, so that fewer of them are the first ones.
        directions = random.normal(size=(MOST_TABLES, MOST_HASHES, dims))[:tables, :hashes]
        offsets = random.uniform(size=(MOST_TABLES, MOST_HASHES))[:tables, :hashes]
        mixers = random.integers(1 << 62, size=(MOST_TABLES, MOST_HASHES + 1), dtype=np.int64)[:tables, : hashes + 1] * 2 + 1
        return HashTables(directions, offsets, width, mixers, recall)

    def _cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x tables x hashes): whole steps, and how far into its step a row is."""
        at = np.einsum("nd,thd->nth", x, self.directions) / self.width + self.offsets
        whole = np.floor(at)
        return whole.astype(np.int64), at - whole

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table. Numbers of different cells are equal by chance only, which does no harm."""
        whole, _ = self._cells(x)
        return (whole * self.mixers[:, :-1]).sum(axis=2) + self.mixers[:, -1]

    def probes(self, x: np.ndarray, most: int = PROBES) -> np.ndarray:
        """The buckets (rows x tables x probes) to look at: the own one, then those across the nearest borders."""
        whole, part = self._cells(x)
        own = (whole * self.mixers[:, :-1]).sum(axis=2) + self.mixers[:, -1]
        gap, side = np.minimum(part, 1 - part), np.where(part < 0.5, -1, 1)
        nearest = np.argsort(gap, axis=2, kind="stable")[:, :, :most]
        step = np.take_along_axis(side * self.mixers[:, :-1], nearest, axis=2)
        return np.concatenate([own[:, :, None], own[:, :, None] + step], axis=2)


def true_neighbours(refs: DataFrame, queries: np.ndarray, k: int, space: Space) -> list[np.ndarray]:
    """The vectors of the k nearest references of a few queries, by one pass over all references."""
    asked = pa.table({"query_id": pa.array(range(len(queries)), pa.int64()), "vector": as_lists(queries), "bound": pa.array(np.full(len(queries), np.inf))})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[float, list[float]]]] = [[] for _ in queries]
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.table({"ref_id": pa.array(range(batch.num_rows), pa.int64()), "copies": pa.array(np.ones(batch.num_rows, dtype=np.int64)), "ref_vector": batch.column(0)})
            near = _nearest(space, k, asked, part)[1].to_pylist()
            for q, found in enumerate(near):
                held[q] = sorted([*held[q], *((c["distance"], batch.column(0)[c["ref_id"]].as_py()) for c in found)])[:k]
        rows = [(q, d, v) for q, h in enumerate(held) for d, v in h]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["q", "distance", "vector"])

    order = Window.partitionBy("q").orderBy("distance")
    top = refs.select("vector").mapInArrow(best, "q int, distance double, vector array<double>")
    rows = top.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).orderBy("q", "distance").collect()
    return [np.array([r["vector"] for r in rows if r["q"] == q]) for q in range(len(queries))]


def choose_tables(refs: DataFrame, k: int, space: Space, recall: float, seed: int = 11) -> HashTables | None:
    """Tables that find the share ``recall`` of true neighbours of some references with the fewest candidates.

    The queries are the PROBE_QUERIES references of least hash, the rows met by chance the RANDOM_ROWS next ones. None
    if every choice compares a third of all rows or more, where an exact search is as good.
    """
    some = [np.array(r["vector"]) for r in refs.orderBy(F.xxhash64("vector"), "vector").limit(PROBE_QUERIES + RANDOM_ROWS).select("vector").collect()]
    queries, random = np.array(some[:PROBE_QUERIES]), np.array(some[PROBE_QUERIES:])
    if not len(random):
        return None
    metric = space.build()
    near = true_neighbours(refs, queries, k, space)
    reaches = np.quantile([metric.pairs(q[None], n)[0].max() for q, n in zip(queries, near)], REACHES)
    owner = np.repeat(np.arange(len(queries)), [len(n) for n in near])
    flat = np.concatenate(near)
    best, least = None, 1 / 3
    for width in sorted({float(r * w) for r in reaches for w in WIDTHS} - {0.0}):
        for hashes in range(MOST_HASHES, 0, -1):
            tables = HashTables.draw(queries.shape[1], MOST_TABLES, hashes, width, seed)
            probes = tables.probes(queries)
            met = (probes[owner] == tables.buckets(flat)[:, :, None]).any(axis=2)
            found = np.maximum.accumulate(met, axis=1).mean(axis=0)
            enough = np.flatnonzero(found >= recall)
            if not len(enough):
                continue
            n = int(enough[0]) + 1
            chance = np.mean([(probes[i, :n, :, None] == tables.buckets(random)[:, :n].T[:, None, :]).any(axis=1).sum(axis=0).mean() for i in range(0, len(queries), 4)])
            if chance < least:
                best, least = HashTables.draw(queries.shape[1], n, hashes, width, seed, float(found[n - 1])), chance
            break
    return best


def approximate_knn_search(queries: DataFrame, refs: DataFrame, k: int, space: Space = Space(), recall: float = 0.95, tables: HashTables | None = None) -> DataFrame:
    """Like ``knn_search``, (query_id, near) for (query_id, vector) and (ref_id, vector, copies), with a recall.

    Of the k nearest references a share of about ``recall`` is found, measured on some references; distances are exact,
    equally near references come by their ids. Buckets with more references or queries than a task should compare are
    split by hash. Queries that meet fewer than k references are searched exactly, so none comes back short.
    """
    if space.metric not in METRICS:
        raise ValueError(f"{space.metric} has no p-stable projections; use one of {', '.join(METRICS)} or the exact search")
    tables = tables or choose_tables(refs, k, space, recall)
    if tables is None:
        return knn_search(queries, refs, k, space)

    def placed(name: str, others: list[str], find):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = find(matrix(batch.column(batch.num_columns - 1))).reshape(batch.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, as_lists(found)], [*others, "vector", name])

        return run

    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(placed("buckets", ["query_id"], tables.probes), "query_id bigint, vector array<double>, buckets array<bigint>")
    offered = refs.select("ref_id", "copies", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(placed("buckets", ["ref_id", "copies"], tables.buckets), "ref_id bigint, copies bigint, vector array<double>, buckets array<bigint>")
    asked = materialise(asked.select("query_id", "vector", F.explode(F.array_distinct("buckets")).alias("bucket")))
    offered = materialise(offered.select("ref_id", "copies", "vector", F.explode(F.array_distinct("buckets")).alias("bucket")))
    # Sizes of buckets that have both sides; hot ones are cut on either side.
    sizes = offered.groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("r"))
    sizes = materialise(sizes.join(asked.groupBy("bucket").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("q")), "bucket"))
    piece = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "bucket").withColumn("qs", piece("query_id", "q")).withColumn("rs", every("r"))
    right = offered.join(sizes, "bucket").withColumn("rs", piece("ref_id", "r")).withColumn("qs", every("q"))
    none = pa.table({"query_id": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.struct([("distance", pa.float64()), ("ref_id", pa.int64()), ("copies", pa.int64())])))})

    def compare(some: pa.Table, others: pa.Table) -> pa.Table:
        if not some.num_rows or not others.num_rows:
            return none
        return pa.table({"query_id": some.column("query_id"), "near": _nearest(space, k, some, others)[1]})

    left = left.select("query_id", "vector", F.lit(float("inf")).alias("bound"), "bucket", "qs", "rs").groupBy("bucket", "qs", "rs")
    right = right.select("ref_id", F.col("vector").alias("ref_vector"), "copies", F.col("bucket").alias("to"), F.col("qs").alias("a"), F.col("rs").alias("b")).groupBy("to", "a", "b")
    met = left.cogroup(right).applyInArrow(compare, f"query_id bigint, near {NEAR}").select("query_id", F.explode("near").alias("c"))
    # A reference met in several tables counts once; the best k are kept before and after the shuffle.
    once = met.groupBy("query_id", F.col("c.ref_id").alias("ref_id")).agg(F.min("c.distance").alias("distance"), F.first("c.copies").alias("copies"))
    order = Window.partitionBy("query_id").orderBy("distance", "ref_id")
    top = once.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    near = materialise(top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("distance", "ref_id", "copies"))).alias("near")))
    full = near.filter(F.aggregate("near", F.lit(0).cast("long"), lambda n, c: n + c["copies"]) >= k)
    short = materialise(queries.select("query_id", "vector").join(full, "query_id", "left_anti"))
    return full if short.isEmpty() else full.unionByName(knn_search(short, refs, k, space))
