"""Mixture-energy anomaly score over compressed rows and their reconstruction errors.

The data flow is that of a deep autoencoding Gaussian mixture (Zong et al., 2018), with a linear
encoder (PCA) and a mixture fitted by penalised EM in place of the jointly trained network.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loginlens.functions.quantile import exact_quantile
from loginlens.operators.detector import VECTOR, Detector, DetectorModel
from loginlens.operators.em import PENALTY, component_logs, fit_mixture, log_density
from loginlens.operators.knn import as_lists, matrix
from loginlens.schema import GROUP, with_field
from loginlens.session import few_partitions, materialise

# Floor added to norms, and to the covariance diagonal.
NORM_FLOOR = 1e-3
DIAGONAL = 1e-6


def reconstruction_errors(x: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Relative distance and half the cosine distance between rows and their reconstructions."""
    size, back_size = np.linalg.norm(x, axis=1), np.linalg.norm(back, axis=1)
    relative = np.linalg.norm(x - back, axis=1) / (size + NORM_FLOOR)
    angle = 0.5 * (1.0 - (x * back).sum(axis=1) / (size * back_size + NORM_FLOOR))
    return np.column_stack([relative, angle])


def mixture_energy(z: np.ndarray, weights: Sequence[float], means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    """-log of the mixture density, computed in logs so that far rows keep their differences."""
    return -log_density(component_logs(z, weights, means, covariances, DIAGONAL))


def add_energy(
    df: DataFrame, columns: Sequence[str], weights: Sequence[float], means: np.ndarray, covariances: np.ndarray, name: str = "energy"
) -> DataFrame:
    """Energy of given columns under given mixture parameters, as one more column."""
    names = df.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])
                energy = pa.array(mixture_energy(z, weights, means, covariances))
                yield pa.RecordBatch.from_arrays([*batch.columns, energy], [*names, name])

    return df.mapInArrow(score, with_field(df.schema, name, T.DoubleType()))


class EnergyParams(Params):
    components = Param(Params._dummy(), "components", "Gaussians in the mixture", TypeConverters.toInt)
    compressed = Param(Params._dummy(), "compressed", "dimensions kept by the encoder", TypeConverters.toInt)
    max_iter = Param(Params._dummy(), "max_iter", "most EM steps", TypeConverters.toInt)
    penalty = Param(Params._dummy(), "penalty", "weight of the penalty on small variances", TypeConverters.toFloat)
    level = Param(Params._dummy(), "level", "quantile of the scores from which rows are flagged", TypeConverters.toFloat)
    random_seed = Param(Params._dummy(), "random_seed", "seed", TypeConverters.toInt)


class MixtureEnergyDetector(Detector, EnergyParams):
    """One-hot group, standardise, compress, add reconstruction errors, score by mixture energy."""

    kind = "DAGMM"

    @classmethod
    def defaults(cls) -> dict[str, Any]:
        # The penalty keeps components from shrinking onto an outlier, however many steps there are.
        return {"components": 4, "compressed": 2, "max_iter": 300, "penalty": PENALTY, "level": 0.9999, "random_seed": 123}

    def _fit(self, df: DataFrame) -> "MixtureEnergyModel":
        model = self._learn(df)
        model.border = exact_quantile(model.energies(df).select("scores"), "scores", self.value("level"))
        return model

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Fit and score the same rows, computing their energies once."""
        model = self._learn(df)
        scored = materialise(model.energies(df).drop(VECTOR))
        model.border = exact_quantile(scored, "scores", self.value("level"))
        return model.judge(scored, df.columns)

    def _learn(self, df: DataFrame) -> "MixtureEnergyModel":
        """Scaling, encoder and mixture; the threshold is still missing."""
        names = self.columns_of(df)
        groups: list[int] = []
        if GROUP in names:
            groups = sorted(r[0] for r in df.select(GROUP).distinct().collect() if r[0] is not None)
        model = MixtureEnergyModel(self, names, groups)
        rows = model.encode_group(self.with_vector(df, names)).select(VECTOR).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            shape = rows.agg(F.count("*").alias("n"), F.max(F.size(VECTOR)).alias("d")).first()
            if not shape["n"]:
                raise ValueError("no rows to fit on")
            at = [F.get(VECTOR, F.lit(j)) for j in range(shape["d"])]
            stats = rows.agg(*[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
            model.centre, model.spread = list(stats[: len(at)]), list(stats[len(at) :])
            scaled = few_partitions(model.scale(rows), shape["n"])
            keep = min(self.value("compressed"), len(at))
            pca = PCA(k=keep, inputCol="v", outputCol="z").fit(scaled.select(array_to_vector(VECTOR).alias("v")))
            model.axes = pca.pc.toArray().tolist()
            latent = model.compress(scaled).select("_latent").persist(StorageLevel.MEMORY_AND_DISK)
            try:
                mixture = fit_mixture(
                    latent, "_latent", self.value("components"), self.value("penalty"), self.value("max_iter"), seed=self.value("random_seed")
                )
            finally:
                latent.unpersist()
            model.weights, model.means, model.covariances = mixture.weights, mixture.means, mixture.covariances
        finally:
            rows.unpersist()
        return model


class MixtureEnergyModel(DetectorModel, EnergyParams):
    kind = "DAGMM"
    STATE = ("groups", "centre", "spread", "axes", "weights", "means", "covariances", "border")

    def __init__(self, detector: MixtureEnergyDetector, columns: list[str], groups: list[int]) -> None:
        super().__init__()
        detector._copyValues(self)
        self.columns, self.groups = columns, groups

    def encode_group(self, rows: DataFrame) -> DataFrame:
        """The group number, last of the inputs, as one 0/1 value per known group."""
        if GROUP not in self.columns:
            return rows
        at = self.columns.index(GROUP)
        rest = [F.get(VECTOR, F.lit(j)) for j in range(len(self.columns)) if j != at]
        flags = [(F.get(VECTOR, F.lit(at)) == F.lit(float(g))).cast("double") for g in self.groups]
        return rows.withColumn(VECTOR, F.array(*rest, *flags))

    def scale(self, rows: DataFrame) -> DataFrame:
        values = [
            (F.get(VECTOR, F.lit(j)) - F.lit(float(m))) / F.lit(float(s)) if s else F.lit(0.0)
            for j, (m, s) in enumerate(zip(self.centre, self.spread))
        ]
        return rows.withColumn(VECTOR, F.array(*values))

    def compress(self, scaled: DataFrame) -> DataFrame:
        """Add ``_latent``: compressed values and the two reconstruction errors."""
        axes, names = np.array(self.axes), scaled.columns

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column(VECTOR))
                    z = x @ axes
                    latent = as_lists(np.column_stack([z, reconstruction_errors(x, z @ axes.T)]))
                    yield pa.RecordBatch.from_arrays([*batch.columns, latent], [*names, "_latent"])

        return scaled.mapInArrow(encode, with_field(scaled.schema, "_latent", T.ArrayType(T.DoubleType())))

    def score(self, scaled: DataFrame) -> DataFrame:
        latent = self.compress(scaled)
        weights, means = self.weights, np.array(self.means)
        covariances, names = np.array(self.covariances), [c for c in latent.columns if c != "_latent"]

        def energy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    values = pa.array(mixture_energy(matrix(batch.column("_latent")), weights, means, covariances))
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], values], [*names, "scores"])

        return latent.mapInArrow(energy, with_field(scaled.schema, "scores", T.DoubleType()))

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.judge(self.energies(df), df.columns)

    def energies(self, df: DataFrame) -> DataFrame:
        return self.score(self.scale(self.encode_group(self.with_vector(df, self.columns))))

    def judge(self, scored: DataFrame, columns: list[str]) -> DataFrame:
        anomaly = (F.col("scores") >= F.lit(float(self.border))).cast("int")
        return scored.select(*columns, "scores", anomaly.alias("anomaly"))

    def state(self) -> dict[str, Any]:
        return {name: getattr(self, name) for name in self.STATE}

    def restore(self, state: dict[str, Any], read) -> None:
        for name in self.STATE:
            setattr(self, name, state[name])
