"""Behaviour features: one row per entity and non-empty time bin."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from loginlens.functions.timebin import TimeBin, as_date, utc_midnight, utc_timestamp
from loginlens.operators.prep import with_entity
from loginlens.schema import KEY, PROPORTION_SETS, VIEW_COUNTS, view_column

MICROS = 1_000_000.0


@dataclass(frozen=True)
class Feature:
    """A user-defined feature: an aggregate over the event rows of one entity and bin.

    ``normalise`` and ``in_means`` say whether it is scaled to 0..1 and averaged per entity,
    ``in_profile`` whether it appears in the per-entity profile.
    """

    name: str
    aggregate: Column
    normalise: bool = True
    in_means: bool = True
    in_profile: bool = True


@dataclass
class FeatureRegistry:
    """User-defined features by name, added to the built-in ones."""

    features: dict[str, Feature] = field(default_factory=dict)

    def add(self, feature: Feature) -> "FeatureRegistry":
        if feature.name in self.features:
            raise ValueError(f"feature {feature.name} exists")
        self.features[feature.name] = feature
        return self

    def left_out_of(self, role: str) -> list[str]:
        """Names of the features whose ``role`` attribute is off."""
        return [f.name for f in self.features.values() if not getattr(f, role)]


def proportion_name(types: Sequence[int]) -> str:
    return "proportion_" + "_".join(str(t) for t in types)


def events_per_second(n: Column, first: Column, last: Column) -> Column:
    """0 for a single event, 1 when all share one instant, else events over elapsed seconds."""
    span = (F.unix_micros(last) - F.unix_micros(first)) / F.lit(MICROS)
    return F.when(n == 1, F.lit(0.0)).when(span == 0, F.lit(1.0)).otherwise(n / span)


def distinct_with_null(column: str) -> Column:
    """Distinct values, NULL counting as one of them."""
    return F.count_distinct(column) + F.max(F.col(column).isNull().cast("long"))


def type_flag(types: Sequence[int]) -> Column:
    return F.coalesce(F.col("logon_type").isin(list(types)), F.lit(False)).cast("long")


def in_bins(
    logons: DataFrame,
    start: dt.date | str,
    end: dt.date | str,
    view: str = "user",
    time_bin: TimeBin = TimeBin(),
    clip_end: bool = False,
) -> DataFrame:
    """Events of the bins covering ``[start, end)`` with their ``entity`` and ``bin``.

    The last bin is whole, so it may hold events after ``end`` unless ``clip_end`` is set.
    """
    first, last = as_date(start), as_date(end)
    stop = utc_midnight(last) if clip_end else utc_timestamp(time_bin.stop(first, last))
    inside = logons.filter((F.col("ts") >= utc_midnight(first)) & (F.col("ts") < stop))
    return with_entity(inside, view).withColumn("bin", time_bin.index(F.col("ts"), first))


def extract_features(
    logons: DataFrame,
    start: dt.date | str,
    end: dt.date | str,
    view: str = "user",
    time_bin: TimeBin = TimeBin(),
    proportions: Sequence[Sequence[int]] = tuple(PROPORTION_SETS),
    registry: FeatureRegistry | None = None,
    clip_end: bool = False,
) -> DataFrame:
    """The feature table of cleaned events.

    One aggregation computes everything. Spark splits it into partial sums on the map side and
    spreads the distinct counts over the counted values, so no task holds all events of a busy
    entity.
    """
    view_column(view)
    events = in_bins(logons, start, end, view, time_bin, clip_end)
    extra = list(registry.features.values()) if registry else []
    totals = events.groupBy(*KEY).agg(
        F.count("*").alias("number_events"),
        *[F.sum(type_flag(p)).alias(f"_t{i}") for i, p in enumerate(proportions)],
        F.min("ts").alias("_first"),
        F.max("ts").alias("_last"),
        *[distinct_with_null(column).alias(name) for name, column in VIEW_COUNTS[view]],
        *[f.aggregate.alias(f.name) for f in extra],
    )
    return feature_columns(totals, start, view, time_bin, proportions, [f.name for f in extra])


def feature_columns(
    totals: DataFrame,
    start: dt.date | str,
    view: str,
    time_bin: TimeBin,
    proportions: Sequence[Sequence[int]],
    extra: Sequence[str] = (),
) -> DataFrame:
    """Feature columns from per-bin totals: counts to shares and rates, bin number to time features."""
    n = F.col("number_events")
    position = time_bin.features(as_date(start))
    return totals.select(
        *KEY,
        *[c.alias(name) for name, c in position.items()],
        n,
        *[(F.col(f"_t{i}") / n).alias(proportion_name(p)) for i, p in enumerate(proportions)],
        events_per_second(n, F.col("_first"), F.col("_last")).alias("events_per_second"),
        *[name for name, _ in VIEW_COUNTS[view]],
        *extra,
    )


def append_features(*batches: DataFrame) -> DataFrame:
    """Feature rows of several batches of bins as one table."""
    table = batches[0]
    for batch in batches[1:]:
        table = table.unionByName(batch)
    return table


def entities(features: DataFrame) -> DataFrame:
    return features.select("entity").distinct()
