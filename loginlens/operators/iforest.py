"""Isolation forest (Liu, Ting and Zhou, 2008) fitted and scored with Spark.

Every tree draws its rows by hashing the row's key, so the forest does not depend on
partitioning and a lost task redraws the same rows. Only the drawn rows are shuffled, at most
``max_samples`` to each tree's task; scoring streams the table past the trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loginlens.functions.quantile import exact_quantile
from loginlens.operators.detector import VECTOR, Detector, DetectorModel
from loginlens.operators.knn import matrix
from loginlens.session import materialise

AUTO_SAMPLES = 256
MAX_TREE_ROWS = 1_000_000  # rows one task may hold to build a tree
NODES_PER_PASS = 1_000_000  # nodes sent to the tasks at once
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, length double"
HASH_SPAN = 1 << 62


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    usual = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, usual))


def grow_tree(points: np.ndarray, features: int, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature or -1, threshold, left, right, path length); random splits down to the height limit."""
    limit = math.ceil(math.log2(max(len(points), 2)))
    usable = rng.permutation(points.shape[1])[:features]
    nodes: list[list] = [[-1, 0.0, -1, -1, 0.0]]
    stack = [(0, np.arange(len(points)), 0)]
    while stack:
        node, rows, depth = stack.pop()
        part = points[rows][:, usable]
        low, high = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(varied):
            nodes[node][4] = depth + float(average_path(len(rows)))
            continue
        pick = int(rng.choice(varied))
        cut = float(rng.uniform(low[pick], high[pick]))
        below = part[:, pick] <= cut
        children = len(nodes)
        nodes[node][:4] = [int(usable[pick]), cut, children, children + 1]
        nodes += [[-1, 0.0, -1, -1, 0.0], [-1, 0.0, -1, -1, 0.0]]
        stack += [(children, rows[below], depth + 1), (children + 1, rows[~below], depth + 1)]
    return [tuple(n) for n in nodes]


class IsolationParams(Params):
    n_estimators = Param(Params._dummy(), "n_estimators", "number of trees", TypeConverters.toInt)
    max_samples = Param(Params._dummy(), "max_samples", "auto, or share of the rows per tree")
    max_features = Param(Params._dummy(), "max_features", "share of the features per tree", TypeConverters.toFloat)
    random_state = Param(Params._dummy(), "random_state", "seed", TypeConverters.toInt)


class IsolationForestDetector(Detector, IsolationParams):
    """Scores are the distance to the contamination threshold: negative means anomaly (-1)."""

    kind = "IF"
    higher_is_worse = False
    anomaly_id = -1

    @classmethod
    def defaults(cls) -> dict[str, Any]:
        return {
            "contamination": 0.0001,
            "n_estimators": 50,
            "max_samples": "auto",
            "max_features": 1.0,
            "random_state": 123,
        }

    def _fit(self, df: DataFrame) -> "IsolationForestModel":
        rows = self.with_vector(df)
        model = self._plant(df, rows)
        model.offset = exact_quantile(model.raw_scores(rows.select(VECTOR)), "scores", self.value("contamination"))
        return model

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Fit and score the same rows, sending them past the trees once."""
        rows = self.with_vector(df)
        model = self._plant(df, rows)
        raw = materialise(model.raw_scores(rows).drop(VECTOR))
        model.offset = exact_quantile(raw, "scores", self.value("contamination"))
        return model.judge(raw, df.columns)

    def _plant(self, df: DataFrame, rows: DataFrame) -> "IsolationForestModel":
        """The forest without its threshold."""
        shape = rows.agg(F.count("*").alias("n"), F.max(F.size(VECTOR)).alias("d")).first()
        if not shape["n"]:
            raise ValueError("no rows to fit on")
        share = self.value("max_samples")
        samples = min(AUTO_SAMPLES, shape["n"]) if share == "auto" else max(1, int(float(share) * shape["n"]))
        if samples > MAX_TREE_ROWS:
            raise ValueError(f"{samples} rows per tree exceed what one task may hold ({MAX_TREE_ROWS}); lower max_samples")
        features = max(1, int(self.value("max_features") * shape["d"]))
        nodes = materialise(self._grow(rows, shape["n"], samples, features, self.value("random_state") or 0))
        return IsolationForestModel(self, self.columns_of(df), nodes, samples)

    def _grow(self, rows: DataFrame, n: int, samples: int, features: int, seed: int) -> DataFrame:
        key = [F.col(c) for c in self.value("keyCols")]
        # Draw slightly more than needed by threshold, then exactly the smallest hashes.
        wanted = samples + 6 * math.sqrt(samples) + 10
        limit = int(min(1.0, wanted / n) * 2 * HASH_SPAN) - HASH_SPAN
        trees = F.explode(F.sequence(F.lit(0), F.lit(self.value("n_estimators") - 1)))
        hashed = rows.select(*key, VECTOR).withColumn("tree", trees)
        hashed = hashed.withColumn("_h", F.shiftright(F.xxhash64(*key, "tree", F.lit(seed)), 1))
        drawn = hashed.filter(F.col("_h") <= F.lit(limit))
        order = Window.partitionBy("tree").orderBy("_h", *self.value("keyCols"))
        exact = drawn.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= samples)

        def build(group: pa.Table) -> pa.Table:
            group = group.sort_by("_n")
            tree = group.column("tree")[0].as_py()
            grown = grow_tree(matrix(group.column(VECTOR)), features, np.random.default_rng([seed & 0xFFFFFFFF, tree]))
            feature, threshold, left, right, length = zip(*grown)
            size = len(grown)
            return pa.table(
                {
                    "tree": pa.array(np.full(size, tree, dtype=np.int32)),
                    "node": pa.array(np.arange(size, dtype=np.int32)),
                    "feature": pa.array(feature, pa.int32()),
                    "threshold": pa.array(threshold, pa.float64()),
                    "left": pa.array(left, pa.int32()),
                    "right": pa.array(right, pa.int32()),
                    "length": pa.array(length, pa.float64()),
                }
            )

        return exact.select("tree", "_n", VECTOR).groupBy("tree").applyInArrow(build, NODE_SCHEMA)


class IsolationForestModel(DetectorModel, IsolationParams):
    kind = "IF"
    higher_is_worse = False
    anomaly_id = -1

    def __init__(self, detector: IsolationForestDetector, columns: list[str], nodes: DataFrame, samples: int) -> None:
        super().__init__()
        detector._copyValues(self)
        self.columns, self.nodes, self.samples, self.offset = columns, nodes, samples, 0.0

    def raw_scores(self, rows: DataFrame) -> DataFrame:
        """Add ``scores`` = -2^(-mean path / expected path): lower is more isolated."""
        sizes = self.nodes.groupBy("tree").count().orderBy("tree").collect()
        passes, held = [[]], 0
        for row in sizes:
            if held and held + row["count"] > NODES_PER_PASS:
                passes.append([])
                held = 0
            passes[-1].append(row["tree"])
            held += row["count"]
        scored = rows.withColumn("_path", F.lit(0.0))
        for i, trees in enumerate(passes):
            if i:
                scored = materialise(scored)
            scored = self._add_paths(scored, trees[0], trees[-1])
        mean = F.col("_path") / F.lit(float(len(sizes)))
        expected = float(average_path(self.samples)) or 1.0
        return scored.withColumn("scores", -F.pow(F.lit(2.0), -mean / F.lit(expected))).drop("_path")

    def _add_paths(self, rows: DataFrame, first: int, last: int) -> DataFrame:
        part = self.nodes.filter(F.col("tree").between(first, last)).orderBy("tree", "node").toPandas()
        base = np.arange(len(part)) - part["node"].to_numpy()
        roots = np.unique(base)
        packed = rows.sparkSession.sparkContext.broadcast(
            (
                part["feature"].to_numpy(),
                part["threshold"].to_numpy(),
                part["left"].to_numpy() + base,
                part["right"].to_numpy() + base,
                part["length"].to_numpy(),
                roots,
            )
        )
        names = rows.columns

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            feature, threshold, left, right, length, tops = packed.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column(VECTOR))
                path = np.zeros(len(x))
                for top in tops:
                    node = np.full(len(x), top)
                    while True:
                        inner = np.flatnonzero(feature[node] >= 0)
                        if not len(inner):
                            break
                        at = node[inner]
                        node[inner] = np.where(x[inner, feature[at]] <= threshold[at], left[at], right[at])
                    path += length[node]
                total = pa.array(batch.column("_path").to_numpy() + path)
                columns = [total if c == "_path" else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names)

        return rows.mapInArrow(score, rows.schema)

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.judge(self.raw_scores(self.with_vector(df, self.columns)), df.columns)

    def judge(self, raw: DataFrame, columns: list[str]) -> DataFrame:
        """Scores relative to the threshold, and -1 for rows below it."""
        scores = F.col("scores") - F.lit(float(self.offset))
        return raw.select(*columns, scores.alias("scores"), F.when(scores < 0, -1).otherwise(1).cast("int").alias("anomaly"))

    def state(self) -> dict[str, Any]:
        return {"samples": self.samples, "offset": self.offset}

    def tables(self) -> dict[str, DataFrame]:
        return {"nodes": self.nodes}

    def restore(self, state: dict[str, Any], read) -> None:
        self.samples, self.offset, self.nodes = state["samples"], state["offset"], read("nodes")
