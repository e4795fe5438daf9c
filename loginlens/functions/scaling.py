"""Scaling and encoding of feature columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

# The exponents tried, and how close to 0 or 1 an exponent counts as log or as none.
BOX_COX_LAMBDAS = [i / 10 for i in range(-20, 21)]
BOX_COX_FUDGE = 0.2


def unit_range(value: Column, low: float | Column, high: float | Column) -> Column:
    """``(x - low) / (high - low)``; 0.5 for a constant column."""
    low = F.lit(low) if isinstance(low, (int, float)) else low
    high = F.lit(high) if isinstance(high, (int, float)) else high
    return F.when(high == low, F.lit(0.5)).otherwise((value - low) / (high - low))


def one_hot(df: DataFrame, column: str, values: Sequence[object], prefix: str) -> DataFrame:
    """Replace a column by one 0/1 column per value, appended last."""
    flags = [F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)).alias(f"{prefix}_{v}") for v in values]
    return df.select(*[c for c in df.columns if c != column], *flags)


def mean_and_sd(df: DataFrame, columns: Sequence[str], population: bool = True) -> dict[str, tuple[float, float]]:
    """Mean and standard deviation per column, in one pass."""
    sd = F.stddev_pop if population else F.stddev_samp
    row = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.avg, sd)]).first()
    return {c: (row[f"avg_{c}"], row[f"{sd.__name__}_{c}"]) for c in columns}


def standardise(df: DataFrame, columns: Sequence[str], stats: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Zero mean and unit population deviation; constant columns become 0."""
    stats = stats or mean_and_sd(df, columns)
    return df.withColumns(
        {
            c: (F.col(c) - F.lit(float(stats[c][0]))) / F.lit(float(stats[c][1])) if stats[c][1] else F.lit(0.0)
            for c in columns
        }
    )


def z_score(value: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd != 0, (value - mean) / sd)


def box_cox(value: Column, lam: float) -> Column:
    """Power transform of positive values; below the domain the transform's limit is taken."""
    if abs(lam - 1) < BOX_COX_FUDGE:
        return value
    if abs(lam) < BOX_COX_FUDGE:
        inside, limit = F.log(value), float("-inf")
    else:
        inside, limit = (F.pow(value, F.lit(lam)) - 1) / F.lit(lam), (-1 / lam if lam > 0 else float("-inf"))
    return F.when(value > 0, inside).otherwise(F.lit(limit))


def box_cox_lambdas(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The exponent of highest likelihood per column; columns with values <= 0 or under three values have none.

    The profile likelihood of every exponent is a variance, so one aggregation over (column,
    exponent) finds them all.
    """
    if not columns:
        return {}
    shape = df.agg(
        *[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)],
        *[F.avg(F.when(F.col(c) > 0, F.log(c))).alias(f"log_{c}") for c in columns],
    ).first()
    positive = [c for c in columns if shape[f"min_{c}"] is not None and shape[f"min_{c}"] > 0]
    if not positive:
        return {}
    # A third distinct value exists when some value lies strictly between the extremes.
    inner = df.agg(
        *[F.max((F.col(c) > shape[f"min_{c}"]) & (F.col(c) < shape[f"max_{c}"])).alias(c) for c in positive]
    ).first()
    usable = [c for c in positive if inner[c]]
    if not usable:
        return {}
    values = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in usable])
    lambdas = F.array(*[F.lit(x) for x in BOX_COX_LAMBDAS])
    tried = df.select(F.explode(values).alias("t")).select("t.*", F.explode(lambdas).alias("lam"))
    power = F.when(F.col("lam") == 0, F.log("x")).otherwise((F.pow("x", "lam") - 1) / F.col("lam"))
    fits = tried.groupBy("c", "lam").agg(F.var_pop(power).alias("v"), F.count("*").alias("n")).collect()
    best: dict[str, tuple[float, float]] = {}
    for row in fits:
        if not row["v"] or not row["v"] > 0:
            continue
        likelihood = row["n"] * (-math.log(row["v"]) / 2 + (row["lam"] - 1) * shape[f"log_{row['c']}"])
        if row["c"] not in best or (likelihood, -row["lam"]) > (best[row["c"]][0], -best[row["c"]][1]):
            best[row["c"]] = (likelihood, row["lam"])
    return {c: lam for c, (_, lam) in best.items()}
