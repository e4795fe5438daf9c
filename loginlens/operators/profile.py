"""The rows behind a ranking: normal and flagged behaviour of the worst entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlens.operators.rank import worst_first
from loginlens.operators.sampling import rows_per_entity
from loginlens.schema import KEY
from loginlens.session import broadcast_if_bounded


def top_entities(ranking: DataFrame, n: int = 50, score: str = "scores", higher_is_worse: bool = True) -> DataFrame:
    """The first ``n`` entities of a ranking that has one row per entity."""
    return ranking.select("entity", score).orderBy(worst_first(higher_is_worse, score), "entity").limit(n).select("entity")


def rows_of(features: DataFrame, entities: DataFrame) -> DataFrame:
    return features.join(entities.select("entity"), "entity", "left_semi")


def rows_not_in(features: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows of the feature table that are not among the marked ones."""
    return features.join(marked.select(*KEY), KEY, "left_anti")


def anomaly_profile(
    features: DataFrame,
    marked: DataFrame,
    entities: DataFrame,
    rows: int = 50,
    seed: int = 123,
    leave_out: Sequence[str] = (),
) -> DataFrame:
    """Rows of the given entities with ``is_outsider``: all marked ones, and a sample of the others.

    The sample is taken per entity before the marked rows are removed from it.
    """
    own = rows_of(features, broadcast_if_bounded(entities))
    drop = [c for c in ("day", *leave_out) if c in features.columns]
    outsider = own.join(marked.select(*KEY), KEY, "left_semi").withColumn("is_outsider", F.lit(True))
    insider = rows_not_in(rows_per_entity(own, rows, seed), marked).withColumn("is_outsider", F.lit(False))
    return insider.unionByName(outsider).drop(*drop)

