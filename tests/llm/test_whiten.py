"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loginlens.llm import queries, whiten

SCHEMA = "vec_id long, embedding array<double>, whitening string, x int"


def integers(vectors):
    return np.floor(np.array(vectors, dtype=np.float64) * 64).astype(np.int64) + 1_000_000


def dense(x):
    """n, sums, falling eigenvalues and eigenvectors of the different rows."""
    distinct = np.unique(x, axis=0)
    away = distinct - distinct.mean(axis=0)
    values, vectors = np.linalg.eigh(away.T @ away / len(distinct))
    return distinct, values[::-1], vectors[:, ::-1]


def same_up_to_sign(a, b, tolerance):
    return np.abs(np.abs(a) - np.abs(b)).max() < tolerance and np.abs(np.outer(a, a) - np.outer(b, b)).max() < 10 * tolerance


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "clash", 1) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("far", [0.0, 1e8])
def test_against_dense(spark, far):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(400, 24)) @ rng.normal(size=(24, 24)) + far
    vectors[100:220] = vectors[5]
    rows = list(enumerate(vectors)) + [(None, vectors[5]), (7, vectors[7])]
    odd = [(900, None), (901, [None] * 24), (902, [float("nan")] * 24), (903, [float("inf")] + [0.0] * 23), (904, [1.0] * 3), (905, []), (906, [1e300] * 24), (907, [-float("inf")] * 24)]
    got, model, error = whiten.whiten(frame(spark, rows + odd).repartition(5))
    assert got.columns == ["vec_id", "embedding", "x", "whitening"]
    got = got.collect()
    x = integers([v for _, v in rows])
    distinct, values, components = dense(x)
    assert sorted((r["vec_id"] for r in got), key=repr) == sorted((i for i, _ in rows), key=repr)
    assert model.rows == len(distinct) == 400 - 120 and model.sums == [int(s) for s in distinct.sum(axis=0)]
    assert np.allclose(model.values, values[:16], rtol=1e-9) and np.allclose(model.explained, values[:16] / values.sum(), rtol=1e-9)
    wanted = (x - distinct.mean(axis=0)) @ components[:, :16] / np.sqrt(values[:16])
    place = {i: n for n, (i, _) in enumerate(rows)}
    found = np.array([r["whitening"]["whitened"] for r in got])
    order = [place[r["vec_id"]] for r in got]
    for c in range(16):
        assert same_up_to_sign(found[:, c], wanted[order][:, c], 1e-6 if far else 1e-9)
    exact = [sum((model.rows * int(v) - s) ** 2 for v, s in zip(row, model.sums)) for row in x]
    for r in got:
        d = exact[place[r["vec_id"]]]
        assert r["whitening"]["deviation"] == (d if d < 1 << 63 else None)
    assert error < 1e-9


@pytest.mark.parametrize("rank", [1, 3, 17, 20])
def test_factors(rank):
    rng = np.random.default_rng(rank)
    a = rng.normal(size=(20, rank)) * 10.0 ** rng.integers(-3, 4, size=rank)
    scatter = a @ a.T
    factor = whiten.pivoted_cholesky(scatter)
    assert np.allclose(factor @ factor.T, scatter, rtol=1e-9, atol=1e-9 * scatter.max())
    # Triangular in the order of the pivots, which are the largest entries left.
    pivots = [int(np.argmax(factor[:, k] ** 2 * (np.abs(factor[:, k + 1 :]).sum(axis=1) == 0))) for k in range(factor.shape[1])]
    assert len(set(pivots)) == factor.shape[1] and all((factor[pivots[:k], k] == 0).all() for k in range(factor.shape[1]))
    values, vectors = whiten.jacobi(factor)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(vectors * values @ vectors.T, scatter, rtol=1e-9, atol=1e-12 * scatter.max())
    assert (np.diff(values) <= 0).all()


def test_equal_and_missing_vectors(spark):
    got, model, error = whiten.whiten(frame(spark, [(i, [1.5, -2.0]) for i in range(5)]))
    assert model.rows == 1 and error == 0.0 and [tuple(r["whitening"]) for r in got.collect()] == [(0, [])] * 5
    got, model, _ = whiten.whiten(frame(spark, [(1, None)]))
    assert model is None and got.count() == 0
    got, model, error = whiten.whiten(frame(spark, [(0, [0.0, 0.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert len(model.values) == 1 and model.explained == [1.0] and error < 1e-12
    assert sorted(abs(r["whitening"]["whitened"][0]) for r in got.collect()) == pytest.approx([1.0] * 3)


def test_huge_entries(spark):
    """Sums beyond a long are exact; deviations beyond one are null."""
    got, model, _ = whiten.whiten(frame(spark, [(i, [2.0**55, float(i)]) for i in range(6)]))
    assert model.sums[0] == 6 * (2**61 + 1_000_000)
    assert all(r["whitening"]["deviation"] == sum((6 * v - s) ** 2 for v, s in zip((2**61 + 1_000_000, 64 * r["vec_id"] + 1_000_000), model.sums)) for r in got.collect())
    got, _, _ = whiten.whiten(frame(spark, [(0, [2.0**55]), (1, [-(2.0**55)])]))
    assert [r["whitening"]["deviation"] for r in got.collect()] == [None, None]


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op12_whitening(spark, sf)
    table = spark.read.parquet(f"{sf}/embeddings.parquet").filter("embedding is not null").toPandas()
    x = integers(np.stack(table["embedding"]).astype(np.float64))
    distinct, values, components = dense(x)
    assert got.count() == 16 * len(table)
    one = got.filter(F.col("component") == 3).toPandas().set_index("vec_id").loc[table["vec_id"]]
    wanted = (x - distinct.mean(axis=0)) @ components[:, 2] / np.sqrt(values[2])
    assert same_up_to_sign(one["whitened"].to_numpy(), wanted, 1e-8)
    assert (one["n"] == len(distinct)).all() and one["explained"].iloc[0] == pytest.approx(values[2] / values.sum())
    assert one["deviation"].tolist() == ((len(distinct) * x - distinct.sum(axis=0)) ** 2).sum(axis=1).tolist()
    assert got.agg(F.max("identity_error")).first()[0] < 1e-4
