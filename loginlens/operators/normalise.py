"""Per-entity means and scaling of features to 0..1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loginlens.functions.scaling import unit_range
from loginlens.schema import numeric_features

MinMax = dict[str, tuple[float, float]]


def entity_means(features: DataFrame, leave_out: Sequence[str] = ()) -> DataFrame:
    """Mean of every behaviour feature over an entity's bins; bins without events do not count."""
    columns = [c for c in numeric_features(features) if c not in set(leave_out)]
    return features.groupBy("entity").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])


def running_sums(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every row with the sums ``s_i`` and counts ``n_i`` of the columns over the entity's bins up to its own.

    Sums are exact, of values rounded to nine decimals, so they do not depend on the order of additions.
    """
    until = Window.partitionBy("entity").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return features.select(
        "*",
        *[F.sum(F.col(c).cast("decimal(26,9)")).over(until).alias(f"s_{i}") for i, c in enumerate(columns)],
        *[F.count(c).over(until).alias(f"n_{i}") for i, c in enumerate(columns)],
    )


def sums_to_means(summed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The means under the columns' names in place of sums and counts; null where nothing was counted."""
    means = [(F.col(f"s_{i}").cast("double") / F.nullif(F.col(f"n_{i}"), F.lit(0))).alias(c) for i, c in enumerate(columns)]
    rest = [c for c in summed.columns if c not in {f"{x}_{i}" for x in "sn" for i in range(len(columns))}]
    return summed.select(*rest, *means)


def running_means(features: DataFrame, leave_out: Sequence[str] = ()) -> DataFrame:
    """Per entity and bin, the mean of every behaviour feature over the entity's bins up to that one."""
    columns = [c for c in numeric_features(features) if c not in set(leave_out)]
    return sums_to_means(running_sums(features, columns).drop(*[c for c in features.columns if c not in ("entity", "bin")]), columns)


def min_max(features: DataFrame, leave_out: Sequence[str] = ()) -> MinMax:
    """Global (min, max) per behaviour feature: one row of partial aggregates, whatever the table size."""
    columns = [c for c in numeric_features(features) if c not in set(leave_out)]
    row = features.agg(
        *[F.min(F.col(c).cast("double")).alias(f"lo_{i}") for i, c in enumerate(columns)],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"lo_{i}"], row[f"hi_{i}"]) for i, c in enumerate(columns)}


def min_max_table(spark: SparkSession, bounds: MinMax) -> DataFrame:
    """The bounds as rows (feature, min, max)."""
    return spark.createDataFrame([(c, lo, hi) for c, (lo, hi) in bounds.items()], "feature string, min double, max double")


def min_max_from_table(bounds: DataFrame) -> MinMax:
    return {r["feature"]: (r["min"], r["max"]) for r in bounds.collect()}


def merge_min_max(stored: MinMax, new: MinMax) -> MinMax:
    """Widen stored bounds by new ones, feature by feature."""
    missing = set(stored) ^ set(new)
    if missing:
        raise ValueError(f"features differ between the bounds: {sorted(missing)}")
    return {c: (min(lo, new[c][0]), max(hi, new[c][1])) for c, (lo, hi) in stored.items()}


def normalise(features: DataFrame, bounds: MinMax | None = None, leave_out: Sequence[str] = ()) -> DataFrame:
    """Behaviour features scaled to 0..1; time features and the group keep their values."""
    bounds = bounds or min_max(features, leave_out)
    return features.withColumns(
        {c: unit_range(F.col(c).cast("double"), float(lo), float(hi)) for c, (lo, hi) in bounds.items()}
    )
