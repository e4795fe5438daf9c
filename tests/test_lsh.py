"""Approximate neighbours against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loginlens.operators import lsh
from loginlens.operators.knn import KNNDetector, Space, knn_search


def table(spark, vectors, copies=None):
    rows = [(i, [float(c) for c in v], int(copies[i]) if copies is not None else 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "ref_id long, vector array<double>, copies long")


def as_queries(refs):
    return refs.select(F.col("ref_id").alias("query_id"), "vector")


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=5, size=(n // 20, dims))
    return centres[rng.integers(0, len(centres), n)] + rng.normal(scale=0.5, size=(n, dims))


def recall(found, wanted, k):
    a, b = ({r["query_id"]: [c["ref_id"] for c in r["near"]][:k] for r in df.collect()} for df in (found, wanted))
    assert set(a) == set(b)
    return np.mean([len(set(a[q]) & set(b[q])) / len(b[q]) for q in b])


@pytest.mark.parametrize("pieces", [2048, 7])
def test_recall_and_exact_distances(spark, monkeypatch, pieces):
    monkeypatch.setattr(lsh, "BUCKET_ROWS", pieces)
    monkeypatch.setattr(lsh, "QUERY_ROWS", pieces)
    vectors = clustered(2000 if pieces > 100 else 900, 12, 1)
    refs = table(spark, vectors).repartition(3)
    tables = lsh.choose_tables(refs, 10, Space(), 0.95)
    assert tables is not None and tables.recall >= 0.95
    found = lsh.approximate_knn_search(as_queries(refs).filter("query_id % 5 = 0"), refs, 10, tables=tables).cache()
    assert recall(found, knn_search(as_queries(refs).filter("query_id % 5 = 0"), refs, 10), 10) >= 0.9
    for r in found.limit(20).collect():
        ids = [c["ref_id"] for c in r["near"]]
        assert len(set(ids)) == 10 == len(ids) and ids[0] == r["query_id"]
        for c in r["near"]:
            assert c["distance"] == pytest.approx(np.linalg.norm(vectors[r["query_id"]] - vectors[c["ref_id"]]), abs=1e-6)


def test_probes_are_the_neighbouring_cells():
    rng = np.random.default_rng(2)
    tables = lsh.HashTables.draw(5, 3, 4, 2.0, 1)
    x = rng.normal(size=(50, 5))
    whole, part = tables._cells(x)
    probes, own = tables.probes(x, 2), tables.buckets(x)
    assert probes.shape == (50, 3, 3) and (probes[:, :, 0] == own).all()
    for i in range(50):
        for t in range(3):
            gaps = sorted((min(p, 1 - p), h) for h, p in enumerate(part[i, t]))
            for probe, (_, h) in zip(probes[i, t, 1:], gaps):
                moved = whole[i, t].copy()
                moved[h] += 1 if part[i, t, h] >= 0.5 else -1
                assert int(probe) == int((moved * tables.mixers[t, :-1]).sum() + tables.mixers[t, -1])


def test_true_neighbours_by_one_pass(spark):
    vectors = clustered(300, 4, 3)
    found = lsh.true_neighbours(table(spark, vectors).repartition(4), vectors[:5], 6, Space())
    for q, near in enumerate(found):
        distances = np.sort(np.linalg.norm(vectors - vectors[q], axis=1))[:6]
        assert np.allclose(np.linalg.norm(near - vectors[q], axis=1), distances, atol=1e-6)


def test_queries_that_meet_nothing_are_searched_exactly(spark):
    vectors = clustered(900, 6, 4)
    refs = table(spark, vectors, np.arange(900) % 3 + 1)
    far = spark.createDataFrame([(-1, [1e6] * 6), (-2, [float(c) for c in vectors[3]])], "query_id long, vector array<double>")
    tables = lsh.HashTables.draw(6, 4, 8, 1.0, 1)
    found = {r["query_id"]: r["near"] for r in lsh.approximate_knn_search(far, refs, 5, tables=tables).collect()}
    wanted = {r["query_id"]: r["near"] for r in knn_search(far, refs, 5).collect()}
    assert [c["ref_id"] for c in found[-1]] == [c["ref_id"] for c in wanted[-1]] and len(found) == 2


def test_other_metrics_and_small_tables(spark):
    refs = table(spark, clustered(40, 3, 5))
    assert lsh.choose_tables(refs, 3, Space(), 0.9) is None
    assert recall(lsh.approximate_knn_search(as_queries(refs), refs, 3), knn_search(as_queries(refs), refs, 3), 3) == 1
    with pytest.raises(ValueError, match="hamming"):
        lsh.approximate_knn_search(as_queries(refs), refs, 3, Space("hamming"))


def test_detector_above_a_limit(spark):
    vectors = clustered(1200, 4, 6)
    vectors[7] += 40
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(vectors)], "id long, a double, b double, c double, d double")
    exact = KNNDetector(featureCols=list("abcd"), n_neighbors=5, contamination=0.001).fit_transform(df)
    near = KNNDetector(featureCols=list("abcd"), n_neighbors=5, contamination=0.001, approximate_above=500).fit_transform(df)
    a, b = ({r["id"]: r["scores"] for r in x.collect()} for x in (exact, near))
    assert np.mean([abs(a[i] - b[i]) < 1e-6 for i in a]) > 0.6 and all(b[i] >= a[i] - 1e-9 for i in a)
    assert max(b, key=b.get) == 7
