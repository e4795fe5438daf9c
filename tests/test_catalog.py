"""Registered queries against their SQL on the smallest data; ``ALL_QUERIES=1`` runs every one."""

import os
from pathlib import Path

import pytest

from checks.catalog import ORACLES, QUERIES
from checks.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SLOW = ("knn_", "stream_", "kmeans_", "spectral", "group_drift", "forest", "ranking_from", "flagged_from", "ranking_with", "mixture", "isolation", "local_")
CHOSEN = [q for q in QUERIES if os.environ.get("ALL_QUERIES") or not q.startswith(SLOW) or q == "knn_features_user_day"]

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    same, text = compare(spark, con, name, SF_DIR)
    assert same is not False, text


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
