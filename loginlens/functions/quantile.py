"""Exact quantiles (linear interpolation between order statistics) of distributed columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Values that may be ordered in one task once the search has narrowed down to them.
SMALL = 50_000


def exact_quantile(
    df: DataFrame, column: str, level: float, weight: str | None = None, small: int = SMALL
) -> float | None:
    """The value at ``level`` of the non-null values; None without any.

    ``weight`` names a column that says how often a row counts.

    Spark's exact ``percentile`` keeps every distinct value of the column in one task. Here values
    are counted first, then rounds of approximate percentiles narrow the range around the two
    wanted order statistics, and only a small number of distinct values is ordered at the end.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(
        (F.sum(weight) if weight else F.count("*")).cast("long").alias("n")
    ).persist()
    try:
        total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
        if not total:
            return None
        position = level * (total - 1)
        low = math.floor(position)
        ranks = sorted({low, min(low + 1, total - 1)})
        values = [_order_statistic(counts, rank, distinct, small) for rank in ranks]
        return values[0] + (values[-1] - values[0]) * (position - low)
    finally:
        counts.unpersist()


def _order_statistic(counts: DataFrame, rank: int, distinct: int, small: int) -> float:
    """Value at 0-based ``rank`` of a table of distinct values with their numbers of occurrences."""
    part, before = counts, 0
    while distinct > small:
        # Cut points by rank among distinct values; a few buckets per round are enough to converge.
        points = part.agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 10_000).alias("p")).first()["p"]
        edges = sorted(set(points))
        bucket = sum(((F.col("v") > F.lit(e)).cast("int") for e in edges), F.lit(0))
        rows = part.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("d")).orderBy("b").collect()
        for row in rows:
            if rank < before + row["n"]:
                break
            before += row["n"]
        index = row["b"]
        if index > 0:
            part = part.filter(F.col("v") > edges[index - 1])
        if index < len(edges):
            part = part.filter(F.col("v") <= edges[index])
        if row["d"] == distinct:
            raise RuntimeError("the cut points no longer divide the values; they are too many to order in one task")
        distinct = row["d"]
    for value, n in part.orderBy("v").collect():
        before += n
        if rank < before:
            return value
    raise AssertionError("rank lies past the last value")
