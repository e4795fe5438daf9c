"""Out-of-bag votes against votes counted tree by tree, and the error against SQL."""

import collections
import math

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loginlens.operators import forest
from loginlens.operators.forest import GROUP, VECTOR, WEIGHT

PARAMS = {"num_trees": 7, "max_depth": 4, "min_node_size": 1, "mtry": 2, "seed": 3, "sample_fraction": 1.0}


def labelled(spark, n=240):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        group = i % 3
        x = rng.normal(size=4) + [2 * group, 0, -group, 0]
        rows.append((f"e{i}", [float(c) for c in x], float(group), 1.0 + group))
    df = spark.createDataFrame(rows, f"entity string, x array<double>, {GROUP} double, {WEIGHT} double")
    return df.select("entity", array_to_vector("x").alias(VECTOR), GROUP, WEIGHT)


def test_counts_follow_a_poisson_law(spark):
    df = spark.range(20_000).select(*[forest.bootstrap_count(F.col("id").cast("string"), b, 1, share).alias(f"n{i}") for i, (b, share) in enumerate([(0, 1.0), (1, 1.0), (0, 0.5)])])
    for i, share in ((0, 1.0), (2, 0.5)):
        seen = collections.Counter(r[i] for r in df.collect())
        for n in range(4):
            assert seen[n] / 20_000 == pytest.approx(math.exp(-share) * share**n / math.factorial(n), abs=0.012)
    assert df.filter("n0 != n1").count() > 5000


def test_votes_tree_by_tree(spark):
    rows = labelled(spark).cache()
    got = {(r["entity"], r["class"]): r["votes"] for r in forest.out_of_bag_votes(rows, PARAMS, bags=3).collect()}
    wanted = collections.defaultdict(float)
    for bag, trees in ((0, 3), (1, 2), (2, 2)):
        drawn = rows.withColumn("n", forest.bootstrap_count(F.col("entity"), bag, 3))
        inside = drawn.filter("n > 0").withColumn(WEIGHT, F.col(WEIGHT) * F.col("n"))
        model = forest._classifier({**forest.DEFAULTS, **PARAMS, "num_trees": trees, "seed": 3 + bag}).setBootstrap(False).fit(inside)
        outside = drawn.filter("n = 0").collect()
        assert {r["entity"] for r in outside}.isdisjoint(r["entity"] for r in inside.collect()) and len(outside) > 50
        for r in outside:
            for tree in model.trees:
                leaf = tree.predictRaw(r[VECTOR]).toArray()
                for c, share in enumerate(leaf / leaf.sum()):
                    wanted[r["entity"], c] += share
    assert set(got) == set(wanted)
    assert all(got[k] == pytest.approx(wanted[k], abs=1e-9) for k in got)


def test_error_equals_sql_and_partitions_do_not_matter(spark):
    rows = labelled(spark)
    one, eight = (forest.out_of_bag_votes(rows.repartition(n), PARAMS, bags=4).cache() for n in (1, 8))
    a, b = ({(r["entity"], r["class"]): r["votes"] for r in v.collect()} for v in (one, eight))
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)
    found = forest.out_of_bag_error(one).first()
    votes = one.toPandas()  # noqa: F841
    ((n, error),) = duckdb.sql(
        """select count(*), avg((class <> label)::int) from (select *, row_number() over (partition by entity order by votes desc, class) as n from votes) where n = 1"""
    ).fetchall()
    assert (found["rows"], found["error"]) == (n, pytest.approx(error)) and 0 < error < 0.35


def test_nothing_out_of_bag(spark):
    rows = labelled(spark, 9)
    assert forest.out_of_bag_votes(rows.limit(0), PARAMS).count() == 0
    assert forest.out_of_bag_error(forest.out_of_bag_votes(rows.limit(0), PARAMS)).first()["error"] is None
