"""Totals per entity and bin that can be merged: batches of events add up, and bins roll up to wider bins.

Distinct counts are kept as HyperLogLog sketches, which merge without the events; all other features stay exact.
``extract_features`` counts exactly and remains the default.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlens.functions.timebin import TimeBin
from loginlens.operators.features import feature_columns, in_bins, type_flag
from loginlens.schema import KEY, PROPORTION_SETS, VIEW_COUNTS, view_column

#: log2 of a sketch's registers: a relative standard error of about 1.04 / sqrt(2 ** 14) = 0.8 %, in at most 16 KB.
LG_K = 14


def mergeable_totals(
    logons: DataFrame,
    start: dt.date | str,
    end: dt.date | str,
    view: str = "user",
    time_bin: TimeBin = TimeBin(),
    proportions: Sequence[Sequence[int]] = tuple(PROPORTION_SETS),
    lg_k: int = LG_K,
    clip_end: bool = False,
) -> DataFrame:
    """Totals of cleaned events by (entity, bin), with a sketch for every distinct count.

    Sketches are filled before the shuffle, so a busy entity costs one small row a task and no spread of its values. NULL is
    one of the counted values, as in the exact counts; a sketch of nothing but NULL is empty. No events, no rows.
    """
    view_column(view)
    return in_bins(logons, start, end, view, time_bin, clip_end).groupBy(*KEY).agg(
        F.count("*").alias("number_events"),
        *[F.sum(type_flag(p)).alias(f"_t{i}") for i, p in enumerate(proportions)],
        F.min("ts").alias("_first"),
        F.max("ts").alias("_last"),
        *[F.hll_sketch_agg(F.col(column).cast("string"), F.lit(lg_k)).alias(f"{name}_sketch") for name, column in VIEW_COUNTS[view]],
        *[F.max(F.col(column).isNull().cast("long")).alias(f"{name}_null") for name, column in VIEW_COUNTS[view]],
    )


def _merged(totals: DataFrame) -> DataFrame:
    def merge(name: str):
        if name == "_first":
            return F.min(name)
        if name == "_last" or name.endswith("_null"):
            return F.max(name)
        return F.hll_union_agg(name, F.lit(False)) if name.endswith("_sketch") else F.sum(name)

    return totals.groupBy(*KEY).agg(*[merge(c).alias(c) for c in totals.columns if c not in KEY])


def add_totals(*batches: DataFrame) -> DataFrame:
    """Totals of several batches of events as one table, also where they share entities and bins.

    Batches must have no event in common; the sketches would not mind, but the sums would.
    """
    table = batches[0]
    for batch in batches[1:]:
        table = table.unionByName(batch)
    return _merged(table)


def roll_up(totals: DataFrame, narrow: TimeBin, wide: TimeBin) -> DataFrame:
    """Totals of ``narrow`` bins as totals of ``wide`` bins of the same start, a whole number of narrow ones each."""
    if wide.width_hours % narrow.width_hours:
        raise ValueError("the wide bin must be a whole number of narrow bins")
    times = wide.width_hours // narrow.width_hours
    return _merged(totals.withColumn("bin", F.floor(F.col("bin") / F.lit(times)).cast("long")))


def features_of_totals(
    totals: DataFrame,
    start: dt.date | str,
    view: str = "user",
    time_bin: TimeBin = TimeBin(),
    proportions: Sequence[Sequence[int]] = tuple(PROPORTION_SETS),
) -> DataFrame:
    """The columns of the exact feature table, with estimated distinct counts."""
    counts = {name: F.hll_sketch_estimate(f"{name}_sketch") + F.col(f"{name}_null") for name, _ in VIEW_COUNTS[view]}
    return feature_columns(totals.withColumns(counts), start, view, time_bin, proportions)
