"""Detectors against brute force and their invariants."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import loginlens.operators.iforest as iforest
from loginlens.functions.quantile import exact_quantile
from loginlens.operators import knn
from loginlens.operators.detector import load_detector
from loginlens.operators.distances import METRICS, build_metric
from loginlens.operators.grouping import GroupModel, fit_groups
from loginlens.operators.iforest import IsolationForestDetector
from loginlens.operators.knn import KNNDetector, distances, fit_space, in_space, join_by_vector, knn_pairs, knn_search
from loginlens.operators.lscp import LSCPDetector
from loginlens.operators.mixture import MixtureEnergyDetector, mixture_energy
from loginlens.plans.params import RULES, check_config
from loginlens.session import new_shared_path

COLUMNS = ["x", "y", "z"]


@pytest.fixture(scope="module")
def points():
    """A lattice-like cloud with copies, and one far row at the end."""
    i = np.arange(300)
    cloud = np.column_stack([(i * 37 % 101) / 100, (i * 53 % 97) / 100, (i % 5) / 4.0])
    cloud[200:280] = cloud[0]
    return np.vstack([cloud, [9.0, 9.0, 9.0]])


@pytest.fixture(scope="module")
def rows(spark, points):
    data = [(f"e{i:03d}", 0, *map(float, p)) for i, p in enumerate(points)]
    return spark.createDataFrame(data, "entity string, bin long, x double, y double, z double").cache()


def brute(points, metric="euclidean"):
    space = build_metric(metric)
    ready = space.prepare(points)
    return np.sort(space.pairs(ready, ready), axis=1)


def scores_of(df):
    return np.array([r["scores"] for r in df.orderBy("entity").select("scores").collect()])


@pytest.mark.parametrize("metric", ["euclidean", "canberra", "braycurtis", "cosine", "jaccard", "yule"])
def test_blocks_never_change_the_neighbours(spark, points, rows, metric):
    """Small blocks force every pruning path; distances must equal those of brute force."""
    vectors = rows.select("entity", F.array(*COLUMNS).alias("v"))
    space = fit_space(vectors, "v", metric)
    ready = in_space(vectors, "v", space)
    vecs = knn.distinct_vectors(ready, "v")
    near = knn_search(vecs.selectExpr("vec_id as query_id", "vector"), vecs.selectExpr("vec_id as ref_id", "vector", "copies"), 9, space, block_rows=8)
    found = ready.join(vecs, ready["v"] == vecs["vector"]).join(near.withColumnRenamed("query_id", "vec_id"), "vec_id")
    got = np.array([r["d"] for r in found.select("entity", distances(F.col("near"), 9).alias("d")).orderBy("entity").collect()])
    assert np.allclose(got, brute(points, metric)[:, :9], atol=1e-12)


def test_every_metric_is_symmetric_and_bounded_by_boxes():
    i = np.arange(60)
    p = np.column_stack([(i * 7 % 11) - 3.0, (i * 5 % 13) / 4.0, i % 3])
    for name in METRICS:
        metric = build_metric(name, np.eye(3) if name in ("seuclidean", "mahalanobis") else None)
        ready = metric.prepare(p)
        d = metric.pairs(ready, ready)
        assert np.allclose(d, d.T), name
        low, high = ready[:20].min(axis=0)[None, :], ready[:20].max(axis=0)[None, :]
        assert (metric.bound(ready, low, high)[:, 0] <= d[:, :20].min(axis=1) + 1e-12).all(), name


SCREENED = ["euclidean", "sqeuclidean", "manhattan", "chebyshev", "canberra", "braycurtis", "cosine", "correlation"]


@pytest.mark.parametrize("name", SCREENED)
def test_screens_keep_every_pair_within_the_limit(name):
    """Most far pairs are ruled out, none within its limit; distances row by row are those of the table."""
    rng = np.random.default_rng(5)
    metric = build_metric(name)
    r = metric.prepare(np.concatenate([rng.normal(size=(400, 32)), np.round(rng.normal(size=(100, 32))), np.zeros((1, 32)), 1e3 + rng.normal(size=(20, 32))]))
    q = np.concatenate([r[::20], -r[5:8], metric.prepare(3 * rng.normal(size=(20, 32)))])
    d = metric.pairs(q, r)
    limit = np.partition(d, 9, axis=1)[:, 9]
    look = metric.screen(r)(q)
    some = np.arange(1, len(q), 2)
    kept = look(some, 100, 521, limit[some])
    assert not ((d[some, 100:] <= limit[some, None]) & ~kept).any()
    assert look(np.arange(0, 25), 0, 400, limit[:25]).mean() < 0.6
    row, col = np.nonzero(d < 1e9)
    assert np.allclose(metric.rows(q[row], r[col]), d[row, col], rtol=0, atol=1e-12 if name in ("cosine", "correlation") else 0)


def test_values_that_single_precision_does_not_hold_are_compared_in_full():
    far = np.array([[0.0, 1e200], [1e-300, 3.0]])
    refs = pa.table({"ref_id": range(300), "copies": [1] * 300, "ref_vector": [[float(i), 1e200 if i % 2 else 3.0] for i in range(300)]})
    asked = pa.table({"query_id": [0, 1], "vector": far.tolist(), "bound": [np.inf, np.inf]})
    near = knn._nearest(knn.Space(), 2, asked, refs)[1].to_pylist()
    assert [[c["ref_id"] for c in n] for n in near] == [[1, 3], [0, 2]]


def test_queries_travel_to_areas_of_blocks_once(spark, monkeypatch):
    """Vectors far from each other: every query meets all blocks, but is sent to few areas, not once to each block."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1600, 16))
    refs = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "ref_id long, vector array<double>, copies long")
    sent, meet = [], knn._meet
    monkeypatch.setattr(knn, "_meet", lambda visits, *rest: sent.append(visits.count()) or meet(visits, *rest))
    near = knn_search(refs.selectExpr("ref_id as query_id", "vector"), refs, 5, block_rows=32)
    got = {r["query_id"]: [c["ref_id"] for c in r["near"]] for r in near.collect()}
    assert sum(sent) <= 1600 * 20
    d = build_metric("euclidean").pairs(x, x)
    assert all(got[i] == list(np.argsort(d[i], kind="stable")[:5]) for i in range(1600))


def test_ensemble_scores_its_training_rows_without_searching_again(spark, rows, monkeypatch):
    from loginlens.operators import lscp

    searches = []
    count = lambda module: monkeypatch.setattr(module, "knn_search", lambda *a, f=module.knn_search, **kw: searches.append(1) or f(*a, **kw))
    detector = LSCPDetector(n_neighbors=5, n_estimators=5, region_size=10, featureCols=COLUMNS)
    wanted = scores_of(detector.fit(rows).transform(rows))
    count(knn), count(lscp)
    assert np.allclose(scores_of(detector.fit_transform(rows)), wanted)
    assert len(searches) == 2


def test_names_for_one_metric_agree():
    p = np.array([[1.0, 0.0, 2.0], [0.0, 3.0, 2.0], [1.0, 1.0, 0.0]])
    for names in (["minkowski", "euclidean", "l2"], ["l1", "cityblock", "manhattan"], ["rogerstanimoto", "sokalmichener"]):
        tables = [build_metric(n).pairs(build_metric(n).prepare(p), build_metric(n).prepare(p)) for n in names]
        assert all(np.array_equal(tables[0], t) for t in tables)


@pytest.mark.parametrize("method", ["mean", "largest", "median"])
def test_knn_scores_count_copies_one_by_one(points, rows, method):
    value = {"mean": lambda d: d.mean(axis=1), "largest": lambda d: d[:, -1], "median": lambda d: np.median(d, axis=1)}[method]
    near = brute(points)
    own = KNNDetector(n_neighbors=6, method=method, featureCols=COLUMNS, contamination=0.01)
    found = own.fit_transform(rows)
    assert np.allclose(scores_of(found), value(near[:, :6]))
    border = np.quantile(value(near[:, 1:7]), 0.99)
    flags = [r["anomaly"] for r in found.orderBy("entity").collect()]
    assert flags == (value(near[:, :6]) > border).astype(int).tolist() and flags[-1] == 1
    others = KNNDetector(n_neighbors=6, method=method, featureCols=COLUMNS, include_self=False).fit_transform(rows)
    assert np.allclose(scores_of(others), value(near[:, 1:7]))


def test_vectors_with_many_copies_are_joined_apart(spark):
    rows = spark.createDataFrame([(i, [float(i % 3 if i < 90 else i)]) for i in range(100)], "id long, v array<double>")
    per_vector = rows.groupBy(F.col("v").alias("vector")).agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    plain = sorted(map(tuple, join_by_vector(rows, per_vector, "v").select("id", "first").collect()))
    split = sorted(map(tuple, join_by_vector(rows, per_vector, "v", hot=10).select("id", "first").collect()))
    assert plain == split and len(split) == 100


def test_neighbour_pairs_leave_out_the_row_itself(points, rows):
    pairs = knn_pairs(rows.select("entity", F.array(*COLUMNS).alias("v")), "entity", "v", 4).collect()
    assert len(pairs) == 4 * len(points) and all(p["entity"] != p["neighbour"] for p in pairs)
    near = brute(points)
    for p in pairs:
        assert abs(p["distance"] - near[int(p["entity"][1:])][p["place"]]) < 1e-12


def test_isolation_forest_finds_the_far_row_whatever_the_partitioning(spark, rows):
    detector = IsolationForestDetector(n_estimators=20, contamination=0.003, featureCols=COLUMNS)
    found = detector.fit_transform(rows)
    scores = scores_of(found)
    assert scores.argmin() == 300 and scores[300] < 0
    # The threshold lies below the second lowest of 301 scores.
    assert [r["entity"] for r in found.filter("anomaly = -1").collect()] == ["e300"]
    again = scores_of(IsolationForestDetector(n_estimators=20, contamination=0.003, featureCols=COLUMNS).fit_transform(rows.repartition(5, "x")))
    assert np.array_equal(scores, again)


def test_forest_in_several_passes_gives_the_same_scores(rows, monkeypatch):
    detector = IsolationForestDetector(n_estimators=6, featureCols=COLUMNS)
    model = detector.fit(rows)
    whole = scores_of(model.transform(rows))
    monkeypatch.setattr(iforest, "NODES_PER_PASS", 600)
    assert np.allclose(scores_of(model.transform(rows)), whole, atol=1e-12)
    monkeypatch.setattr(iforest, "MAX_TREE_ROWS", 100)
    with pytest.raises(ValueError):
        detector.fit(rows)


def test_mixture_energy_is_minus_log_density():
    z = np.array([[0.0, 0.0], [3.0, -4.0], [1e6, 0.0]])
    energy = mixture_energy(z, [1.0], [[0.0, 0.0]], [np.eye(2) * (1 - 1e-6)])
    assert np.allclose(energy, np.log(2 * np.pi) + (z**2).sum(axis=1) / 2)
    parts = mixture_energy(z[:2], [0.3, 0.7], [[0, 0], [1, 1]], [np.eye(2), np.eye(2) * 2])
    single = [mixture_energy(z[:2], [1.0], [m], [c]) for m, c in (([0, 0], np.eye(2)), ([1, 1], np.eye(2) * 2))]
    assert np.allclose(parts, -np.log(0.3 * np.exp(-single[0]) + 0.7 * np.exp(-single[1])))


def test_saved_detectors_score_the_same(spark, rows):
    grouped = rows.withColumn("group_id", (F.hash("entity") % 2).cast("int"))
    for detector in (
        KNNDetector(n_neighbors=5, metric="seuclidean"),
        IsolationForestDetector(n_estimators=5),
        MixtureEnergyDetector(components=2, max_iter=5),
        LSCPDetector(n_neighbors=5, n_estimators=5, region_size=10),
    ):
        model, path = detector.fit(grouped), new_shared_path(spark, "model")
        model.save(path)
        loaded = load_detector(path, detector.kind)
        assert np.allclose(scores_of(model.transform(grouped)), scores_of(loaded.transform(grouped)), atol=1e-9), detector.kind
        assert model.transform(grouped).columns == [*grouped.columns, "scores", "anomaly"]
        with pytest.raises(ValueError):
            load_detector(path, "other")
        with pytest.raises(ValueError):
            loaded.transform(grouped.drop("y"))


def test_far_row_has_the_worst_energy_and_ensemble_score(rows):
    for detector in (MixtureEnergyDetector(components=2, max_iter=5, featureCols=COLUMNS), LSCPDetector(n_neighbors=5, n_estimators=20, region_size=10, featureCols=COLUMNS)):
        assert scores_of(detector.fit_transform(rows)).argmax() == 300, detector.kind


def test_groups_are_numbered_by_their_centres(spark):
    means = spark.createDataFrame([(f"e{i}", float(10 * (i % 3)), 1.0) for i in range(30)], "entity string, a double, b double")
    model = fit_groups(means, k=3, restarts=2)
    found = {r["entity"]: r["group_id"] for r in model.assign(means).collect()}
    assert all(found[f"e{i}"] == i % 3 + 1 for i in range(30))
    path = new_shared_path(spark, "groups")
    model.save(path)
    new = spark.createDataFrame([("n", 19.0, 1.0)], means.schema)
    assert GroupModel.load(path).assign(new).first()["group_id"] == 3
    assert {r["group_id"] for r in fit_groups(means.limit(2), k=13, restarts=1).assign(means).collect()} <= {1, 2}


@pytest.mark.parametrize("level", [0.0, 0.5, 0.9, 0.9999, 1.0])
def test_exact_quantile_narrows_to_the_same_value(spark, level):
    values = [float((i * 7919) % 1009) / 7 for i in range(3000)] + [5.0] * 1000
    df = spark.createDataFrame([(v, 1) for v in values], "v double, w int")
    assert exact_quantile(df, "v", level, small=20) == pytest.approx(np.quantile(values, level), abs=1e-12)
    assert exact_quantile(df, "v", level, weight="w") == pytest.approx(np.quantile(values, level), abs=1e-12)


def test_parameter_ranges():
    good = {"contamination": 0.0001, "n_neighbors": 20, "method": "mean", "metric": "minkowski"}
    check_config("kNN", good, rows=20)
    for bad in ({"contamination": 0.0}, {"contamination": 1.0}, {"n_neighbors": 0}, {"n_neighbors": 2.5}, {"method": "max"}, {"metric": 3}, {"metric": "far"}):
        with pytest.raises(ValueError):
            check_config("kNN", {**good, **bad})
    with pytest.raises(ValueError):
        check_config("kNN", good, rows=19)
    with pytest.raises(ValueError):
        check_config("kNN", {**good, "extra": 1})
    with pytest.raises(ValueError):
        IsolationForestDetector(n_estimators=0)
    IsolationForestDetector(max_samples=0.5)
    for bad in ("all", 0.0, 1.5):
        with pytest.raises(ValueError):
            IsolationForestDetector(max_samples=bad)
    assert set(RULES) == {"IF", "kNN", "RF", "DAGMM", "LSCP"}


def test_hamming_neighbours_are_counted(spark, monkeypatch):
    """Scores as from all pairs, without any comparison of vectors."""
    rng = np.random.default_rng(4)
    seen, new = (rng.integers(0, 3, size=(n, 4)).astype(float) * [1, -0.0, 1, 1] for n in (70, 15))
    new[0], new[1] = 9.0, np.nan
    frames = [spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, v array<double>") for rows in (seen, new)]
    monkeypatch.setattr(knn, "knn_search", None)
    detector = KNNDetector(vectorCol="v", keyCols=["id"], metric="hamming", n_neighbors=7)
    model = detector.fit(frames[0])
    for rows, got in ((seen, detector.fit_transform(frames[0])), (new, model.transform(frames[1]))):
        found = {r["id"]: r["scores"] for r in got.collect()}
        assert len(found) == len(rows)
        for i, v in enumerate(rows):
            assert found[i] == pytest.approx(np.sort((seen != v).mean(axis=1))[:7].mean())


def test_hamming_counts_are_not_broadcast(spark):
    """The sets of coordinates make many rows out of each; Spark's estimate leaves them out."""
    bits = F.array(*[F.shiftright("id", j).bitwiseAND(F.lit(1)).cast("double") for j in range(6)])
    refs = spark.range(64).select(F.col("id").alias("ref_id"), bits.alias("vector"), F.lit(1).cast("long").alias("copies"))
    near = knn.hamming_distances(refs.select(F.col("ref_id").alias("query_id"), "vector"), refs, 6)
    joins = [line for line in near._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in line and "[set#" in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
    assert all([c["copies"] for c in r["near"]] == [1, 6, 15, 20, 15, 6, 1] for r in near.collect())


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev", "braycurtis", "cosine", "jaccard"])
def test_areas_are_looked_for_in_larger_boxes(metric):
    """The boxes found are those of a look at all, and queries near each other look at few."""
    rng = np.random.default_rng(12)
    m = build_metric(metric)
    boxes = [m.prepare(np.concatenate([rng.normal(size=(10, 3)) / 20 + rng.normal(size=3), np.zeros((2, 3))] if metric == "jaccard" else [rng.normal(size=(10, 3)) / 20 + [i / 20, 1.0, 1.0]])) for i in range(700)]
    low, high = (np.array([f(b, axis=0) for b in boxes]) for f in (np.min, np.max))
    low[5], high[5] = np.inf, -np.inf  # a block without rows
    levels = knn.box_levels(low, high, 8)
    assert [len(a) for a, _ in levels] == [2, 11, 88, 700]
    q = m.prepare(rng.normal(size=(40, 3)) / 20 + [3.0, 1.0, 1.0])
    for reach in (0.0, 0.01, 0.2, np.inf):
        bound = np.full(len(q), reach)
        some, near = knn.boxes_within(m, q, bound, levels, 8)
        found = np.zeros((len(q), len(low)), dtype=bool)
        found[:, some] = near
        expected = ~(knn._least(m, q, low, high) > bound[:, None])
        assert (np.delete(found == expected, 5, axis=1)).all() and (np.diff(some) > 0).all()
        assert metric != "euclidean" or reach > 0.2 or len(some) < 100
