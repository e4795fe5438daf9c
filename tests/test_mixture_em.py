"""Penalised EM: monotone, independent of partitions, and outliers stay unlikely."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loginlens.operators.em import Mixture, em_step, first_mixture, fit_mixture, next_mixture, share_sums
from loginlens.operators.mixture import MixtureEnergyDetector, mixture_energy

KIND = "array<double>"


@pytest.fixture(scope="module")
def points():
    draw = np.random.default_rng(5)
    two = np.concatenate([draw.normal([0, 0], 0.5, (300, 2)), draw.normal([4, 1], [0.3, 1.0], (200, 2))])
    return np.concatenate([two, [[30.0, -25.0]]])


def frame(spark, z, parts=3):
    return spark.createDataFrame([(r.tolist(),) for r in z], f"z {KIND}").repartition(parts).persist()


def one_step(z, mixture, penalty):
    """The same step written with whole densities."""
    d = z.shape[1]
    dense = []
    for w, m, s in zip(mixture.weights, mixture.means, np.array(mixture.covariances)):
        away = z - m
        dense.append(w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(s), away)) / np.sqrt((2 * np.pi) ** d * np.linalg.det(s)))
    shares = np.array(dense) / sum(dense)
    n = shares.sum(axis=1)
    means = shares @ z / n[:, None]
    spread = [(r[:, None] * (z - m)).T @ (z - m) / k + np.eye(d) * 2 * penalty * len(z) / k for r, m, k in zip(shares, means, n)]
    return n / len(z), means, np.array(spread), np.log(sum(dense)).mean() - penalty * sum(np.trace(np.linalg.inv(s)) for s in np.array(mixture.covariances))


def test_step_equals_brute_force(spark, points):
    start = Mixture([0.3, 0.7], [[0.0, 0.0], [3.0, 1.0]], [np.eye(2).tolist(), [[9.0, 0.5], [0.5, 9.0]]])
    after, value = em_step(frame(spark, points), "z", start, 0.01)
    for found, expected in zip((after.weights, after.means, after.covariances, value), one_step(points, start, 0.01)):
        assert np.allclose(found, expected, atol=1e-9)


def test_steps_never_lose_and_do_not_depend_on_partitions(spark, points):
    whole, cut = frame(spark, points, 1), frame(spark, points, 8)
    mixture = first_mixture(whole, "z", 3, 0.001, seed=1)
    assert mixture == first_mixture(cut, "z", 3, 0.001, seed=1)
    values = []
    for _ in range(5):
        other, _ = em_step(cut, "z", mixture, 0.001)
        mixture, value = em_step(whole, "z", mixture, 0.001)
        assert np.allclose(other.covariances, mixture.covariances, atol=1e-9) and np.allclose(other.means, mixture.means, atol=1e-9)
        values.append(value)
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:]))


def test_planted_outlier_keeps_the_top_energy_after_many_steps(spark, points):
    """The steps of Spark's partitions, without Spark; the second start has a component on the outlier alone."""
    held = Mixture([0.5, 0.5 - 1 / 501, 1 / 501], [[0, 0], [4, 1], [30, -25]], [np.eye(2).tolist()] * 2 + [(np.eye(2) * 1e-3).tolist()])
    for mixture in (first_mixture(frame(spark, points), "z", 4, 0.001, seed=123), held):
        for _ in range(300):
            mixture, _ = next_mixture(share_sums(iter([points[:200], points[200:]]), mixture), mixture, 0.001)
        energy = mixture_energy(points, mixture.weights, mixture.means, mixture.covariances)
        assert energy.argmax() == len(points) - 1


def test_edges(spark):
    with pytest.raises(ValueError):
        fit_mixture(spark.createDataFrame([], f"z {KIND}"), "z", 2)
    with pytest.raises(ValueError):
        em_step(spark.createDataFrame([], f"z {KIND}"), "z", Mixture([1.0], [[0.0]], [[[1.0]]]))
    with pytest.raises(ValueError):
        fit_mixture(spark.createDataFrame([([float("nan")],), ([1.0],)], f"z {KIND}"), "z", 1)
    with pytest.raises(ValueError):
        fit_mixture(spark.createDataFrame([([1.0],)], f"z {KIND}"), "z", 1, penalty=0)
    same = fit_mixture(spark.createDataFrame([([1.0, 2.0],)] * 5, f"z {KIND}"), "z", 3)
    assert same.weights == [1.0] and same.means == [[1.0, 2.0]]
    assert np.allclose(same.covariances, np.eye(2) * 0.002)


def test_detector_flags_the_far_row_with_default_steps(spark, points):
    rows = spark.createDataFrame([(f"e{i}", i, *r.tolist()) for i, r in enumerate(points)], "entity string, bin long, x double, y double")
    scored = MixtureEnergyDetector(featureCols=["x", "y"], compressed=1).fit_transform(rows)
    assert scored.orderBy(F.desc("scores")).first()["entity"] == f"e{len(points) - 1}"
