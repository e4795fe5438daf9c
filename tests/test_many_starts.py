"""k-means from many starts in one pass: against plain sums, one and eight partitions, and sequential fits."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loginlens.operators import grouping, kmeans
from loginlens.operators.grouping import fit_groups


@pytest.fixture(scope="module")
def points():
    draw = np.random.default_rng(5)
    centres = draw.uniform(-40, 40, (9, 3))
    return np.vstack([c + draw.normal(0, 3, (40, 3)) for c in centres] + [draw.uniform(-60, 60, (40, 3))])


@pytest.fixture(scope="module")
def table(spark, points):
    rows = [(f"e{i}", [float(v) for v in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "entity string, v array<double>").cache()


def test_one_pass_equals_plain_sums(points, table):
    starts = kmeans.spread_starts(points, 5, 7, seed=3)
    found = kmeans.pass_over(table.repartition(3), "v", starts)
    for s, centres in enumerate(starts):
        gaps = ((points[:, None, :] - centres) ** 2).sum(axis=2)
        label = gaps.argmin(axis=1)
        for c in range(5):
            own = points[label == c]
            assert found[s, c, 0] == len(own)
            assert found[s, c, 1] == pytest.approx(gaps[label == c, c].sum())
            assert found[s, c, 2:] == pytest.approx((own - centres[c]).sum(axis=0), abs=1e-9)
        assert kmeans.moved(starts, found)[s] == pytest.approx(np.array([points[label == c].mean(axis=0) for c in range(5)]))


def test_same_centres_for_one_and_eight_partitions(table, monkeypatch):
    """Also when the starts see a part of the rows only."""
    for most in (4096, 60):
        monkeypatch.setattr(kmeans, "START_ROWS", most)
        one, eight = (kmeans.fit_centres(table.repartition(n), "v", 9, starts=20) for n in (1, 8))
        assert one[0] == pytest.approx(eight[0]) and one[1] == pytest.approx(eight[1])


def test_cost_is_never_above_sequential_fits(points, table):
    rows = table.select("entity", *[F.col("v")[i].alias(f"x{i}") for i in range(3)])
    model = fit_groups(rows, k=9)
    vectors = table.select(array_to_vector("v").alias("features")).cache()
    sequential = min(KMeans(k=9, seed=123 + s, maxIter=50).fit(vectors).summary.trainingCost for s in range(5))
    assert model.cost <= sequential * (1 + 1e-9)
    gaps = ((points[:, None, :] - np.array(model.centres)) ** 2).sum(axis=2)
    assert model.cost == pytest.approx(gaps.min(axis=1).sum())
    found = {r["entity"]: r["group_id"] for r in model.assign(rows).collect()}
    assert [found[f"e{i}"] for i in range(len(points))] == (gaps.argmin(axis=1) + 1).tolist()


def test_passes_are_dealt_to_several_tasks(spark, points, monkeypatch):
    """Small rows that every start compares are not one task's work, and the groups stay the same."""
    rows = spark.createDataFrame([(f"e{i}", *map(float, p)) for i, p in enumerate(points)], "entity string, x0 double, x1 double, x2 double").coalesce(1)
    whole, parts, look = fit_groups(rows, k=9, restarts=5), [], kmeans.pass_over

    def counted(rows, vector, centres):
        parts.append(rows.rdd.getNumPartitions())
        return look(rows, vector, centres)

    monkeypatch.setattr(grouping, "TASK_ROWS", 100)
    monkeypatch.setattr(kmeans, "pass_over", counted)
    dealt = fit_groups(rows, k=9, restarts=5)
    assert set(parts) == {4}
    assert np.array(dealt.centres) == pytest.approx(np.array(whole.centres)) and dealt.cost == pytest.approx(whole.cost)


def test_few_rows_nulls_and_empty_tables(spark, table):
    same = spark.createDataFrame([("a", [1.0, 2.0])] * 5 + [("b", [3.0, 2.0])], table.schema)
    centres, cost = kmeans.fit_centres(same, "v", 4, starts=3)
    assert centres.tolist() == [[1.0, 2.0], [3.0, 2.0]] and cost == 0
    with pytest.raises(ValueError):
        kmeans.fit_centres(same.limit(0), "v", 2, starts=3)
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            kmeans.fit_centres(same.union(spark.createDataFrame([("c", [0.0, bad])], table.schema)), "v", 2, starts=3)
    model = fit_groups(spark.createDataFrame([("a", 1.0), ("b", 5.0)], "entity string, x double"), k=2)
    with pytest.raises(Exception, match="finite"):
        model.assign(spark.createDataFrame([("c", None)], "entity string, x double")).collect()
