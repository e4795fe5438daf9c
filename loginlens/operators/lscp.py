"""Locally selected detectors (Zhao et al., 2019): each row uses the detector that fits its neighbourhood."""

from __future__ import annotations

from typing import Any

from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlens.functions.quantile import exact_quantile
from loginlens.functions.scaling import standardise
from loginlens.operators.detector import VECTOR, Detector, DetectorModel, load_detector
from loginlens.operators.iforest import IsolationForestDetector, IsolationForestModel
from loginlens.operators.knn import KNNDetector, KNNModel, Space, distinct_vectors, join_by_vector, knn_search
from loginlens.session import materialise

STANDARD = ["_a", "_b"]


def pick_locally(pairs: DataFrame, row_key: str, detectors: list[str], target: str) -> DataFrame:
    """Per row the detector whose scores correlate best with the target over its region.

    ``pairs`` has one line per row and region member with the member's detector scores and target.
    Returns (row_key, best) with the detector's index; ties and constant scores take the first.
    """
    corr = [F.coalesce(F.nullif(F.corr(d, target), F.lit(float("nan"))), F.lit(-2.0)).alias(f"_c{i}") for i, d in enumerate(detectors)]
    by_row = pairs.groupBy(row_key).agg(*corr)
    best = F.array_position(F.array(*[F.col(f"_c{i}") for i in range(len(detectors))]), F.greatest(*[F.col(f"_c{i}") for i in range(len(detectors))]))
    return by_row.select(row_key, (best - 1).cast("int").alias("best"))


class LSCPParams(Params):
    region_size = Param(Params._dummy(), "region_size", "training rows in a region", TypeConverters.toInt)
    n_neighbors = Param(Params._dummy(), "n_neighbors", "neighbours of the distance detector", TypeConverters.toInt)
    n_estimators = Param(Params._dummy(), "n_estimators", "trees of the isolation detector", TypeConverters.toInt)


class LSCPDetector(Detector, LSCPParams):
    """Ensemble of the nearest-neighbour and the isolation detector.

    Both scores are standardised with higher meaning worse; their maximum is the pseudo target. A
    row takes the score of the detector that correlates best with the target in its region, the
    nearest distinct training vectors.
    """

    kind = "LSCP"

    @classmethod
    def defaults(cls) -> dict[str, Any]:
        return {"contamination": 0.001, "region_size": 30, "n_neighbors": 20, "n_estimators": 50}

    def _members(self) -> tuple[KNNDetector, IsolationForestDetector]:
        common = {"featureCols": self.value("featureCols"), "vectorCol": self.value("vectorCol"), "keyCols": self.value("keyCols")}
        return (
            KNNDetector(n_neighbors=self.value("n_neighbors"), **common),
            IsolationForestDetector(n_estimators=self.value("n_estimators"), contamination=0.001, **common),
        )

    def _fit(self, df: DataFrame) -> "LSCPModel":
        return self._learn(df)[0]

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Fit and score the same rows, with one neighbour search for the distance detector and one for the regions."""
        model, scored = self._learn(df)
        return model.attach(df, scored.select("vector", "copies", "scores"))

    def _learn(self, df: DataFrame) -> tuple["LSCPModel", DataFrame]:
        by_distance, by_isolation = self._members()
        knn, near = by_distance._learn(df)
        model = LSCPModel(self, self.columns_of(df), knn, by_isolation.fit(df))
        # One line per distinct training vector; equal vectors have equal scores.
        scored = model.with_isolation(near.select(F.col("vector").alias(VECTOR), "copies", F.col("scores").alias("_a")))
        weight = F.col("copies")
        moments = scored.agg(
            *[(F.sum(F.col(c) * weight) / F.sum(weight)).alias(f"m{c}") for c in STANDARD],
            *[(F.sum(F.col(c) * F.col(c) * weight) / F.sum(weight)).alias(f"q{c}") for c in STANDARD],
        ).first()
        for c in STANDARD:
            mean = moments[f"m{c}"]
            model.stats[c] = (mean, max(moments[f"q{c}"] - mean * mean, 0.0) ** 0.5)
        known = standardise(scored, STANDARD, model.stats).withColumn("_target", F.greatest(*STANDARD))
        model.train = materialise(
            known.select(
                F.monotonically_increasing_id().alias("ref_id"), F.col(VECTOR).alias("vector"), "copies", *STANDARD, "_target"
            )
        )
        combined = materialise(model.combine(model.train.select(F.col("ref_id").alias("query_id"), "vector", "copies", *STANDARD)))
        model.border = exact_quantile(combined, "scores", 1 - self.value("contamination"), weight="copies")
        return model, combined


class LSCPModel(DetectorModel, LSCPParams):
    kind = "LSCP"

    def __init__(self, detector: LSCPDetector, columns: list[str], knn: KNNModel, forest: IsolationForestModel) -> None:
        super().__init__()
        detector._copyValues(self)
        self.columns, self.knn, self.forest = columns, knn, forest
        self.stats: dict[str, tuple[float, float]] = {}
        self.train: DataFrame | None = None
        self.border: float | None = None

    def member_scores(self, vectors: DataFrame) -> DataFrame:
        """Raw scores of both detectors for distinct vectors, higher meaning worse."""
        knn = self.knn.copy()
        knn._set(vectorCol="_v")
        knn.columns = ["_v"]
        return self.with_isolation(knn.transform(vectors.withColumn("_v", F.col(VECTOR))).withColumnRenamed("scores", "_a").drop("anomaly", "_v"))

    def with_isolation(self, by_distance: DataFrame) -> DataFrame:
        forest = self.forest.copy()
        forest._set(vectorCol="_v")
        forest.columns = ["_v"]
        both = forest.transform(by_distance.withColumn("_v", F.col(VECTOR)))
        return both.withColumn("_b", -F.col("scores")).drop("scores", "anomaly", "_v")

    def combine(self, queries: DataFrame) -> DataFrame:
        """Add ``scores`` to distinct vectors (query_id, vector, standardised member scores)."""
        near = knn_search(
            queries.select("query_id", "vector"),
            self.train.select("ref_id", "vector", F.lit(1).cast("long").alias("copies")),
            self.value("region_size"),
            Space(),
        )
        region = near.select("query_id", F.explode("near.ref_id").alias("ref_id"))
        renamed = self.train.select("ref_id", F.col("_a").alias("_ra"), F.col("_b").alias("_rb"), "_target")
        best = pick_locally(region.join(renamed, "ref_id"), "query_id", ["_ra", "_rb"], "_target")
        chosen = F.when(F.col("best") == 1, F.col("_b")).otherwise(F.col("_a"))
        return queries.join(best, "query_id").withColumn("scores", chosen).drop("best")

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = self.with_vector(df, self.columns)
        distinct = distinct_vectors(rows.select(VECTOR), VECTOR)
        members = self.member_scores(distinct.select(F.col("vec_id").alias("query_id"), F.col("vector").alias(VECTOR), "copies"))
        scaled = standardise(members, STANDARD, self.stats).withColumnRenamed(VECTOR, "vector")
        return self.attach(df, materialise(self.combine(materialise(scaled)).select("vector", "copies", "scores")))

    def attach(self, df: DataFrame, scores: DataFrame) -> DataFrame:
        """Scores of distinct vectors back on the rows."""
        anomaly = (F.col("scores") > F.lit(float(self.border))).cast("int")
        return join_by_vector(self.with_vector(df, self.columns), scores, VECTOR).select(*df.columns, "scores", anomaly.alias("anomaly"))

    def state(self) -> dict[str, Any]:
        return {"stats": self.stats, "border": self.border}

    def tables(self) -> dict[str, DataFrame]:
        return {"train": self.train}

    def save(self, path: str) -> None:
        super().save(path)
        self.knn.save(f"{path}/knn")
        self.forest.save(f"{path}/forest")

    def restore(self, state: dict[str, Any], read) -> None:
        self.stats = {c: tuple(v) for c, v in state["stats"].items()}
        self.border, self.train = state["border"], read("train")

    def load_members(self, path: str) -> None:
        self.knn, self.forest = load_detector(f"{path}/knn", "kNN"), load_detector(f"{path}/forest", "IF")
