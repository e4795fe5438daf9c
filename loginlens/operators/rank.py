"""Rankings of entities from scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from loginlens.functions.quantile import exact_quantile
from loginlens.functions.scaling import unit_range
from loginlens.session import materialise

ROW_BITS = 33


def worst_first(higher_is_worse: bool = True, score: str = "scores") -> Column:
    return F.desc_nulls_last(score) if higher_is_worse else F.asc_nulls_last(score)


def sort_by_score(scored: DataFrame, higher_is_worse: bool = True) -> DataFrame:
    return scored.orderBy(worst_first(higher_is_worse), "entity", "bin")


def flagged(scored: DataFrame, anomaly: int = 1) -> DataFrame:
    """Rows a detector marked."""
    return scored.filter(F.col("anomaly") == anomaly)


def above_percentile(scored: DataFrame, level: float = 0.9999, score: str = "scores") -> DataFrame:
    """Rows whose score reaches the given quantile of all scores."""
    border = exact_quantile(scored, score, level)
    return scored.limit(0) if border is None else scored.filter(F.col(score) >= F.lit(border))


def worst_row_per_entity(scored: DataFrame, higher_is_worse: bool = True) -> DataFrame:
    order = Window.partitionBy("entity").orderBy(worst_first(higher_is_worse), "bin")
    return scored.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def rank_first(scored: DataFrame, higher_is_worse: bool = True) -> DataFrame:
    """The worst row of every entity, worst entity first."""
    return sort_by_score(worst_row_per_entity(scored, higher_is_worse), higher_is_worse)


def mean_scores(scored: DataFrame) -> DataFrame:
    return scored.groupBy("entity").agg(F.avg("scores").alias("mean_score"))


def rank_mean(scored: DataFrame, higher_is_worse: bool = True) -> DataFrame:
    """Mean score per entity, worst first."""
    return mean_scores(scored).orderBy(worst_first(higher_is_worse, "mean_score"), "entity")


def feature_variance(features: DataFrame, feature: str = "Hosts_per_User") -> DataFrame:
    """Sample variance of a feature per entity; NULL for an entity with one row."""
    spread = F.when(F.count(feature) > 1, F.var_samp(feature))
    return features.groupBy("entity").agg(spread.alias("variance"))


def rank_variance(scored: DataFrame, higher_is_worse: bool = True, feature: str = "Hosts_per_User") -> DataFrame:
    """Scores scaled to 0..1 (1 = worst) times the entity's variance of a feature, then as ``rank_first``."""
    if feature not in scored.columns:
        raise ValueError(f"the variance ranking needs {feature}, which only the user view has")
    low, high = scored.agg(F.min("scores"), F.max("scores")).first()
    if low is None:
        return scored.limit(0)
    worst, best = (high, low) if higher_is_worse else (low, high)
    oriented = unit_range(F.col("scores"), float(best), float(worst))
    weighted = scored.withColumn("scores", oriented).join(feature_variance(scored, feature), "entity")
    return rank_first(weighted.withColumn("scores", F.col("scores") * F.col("variance")).drop("variance"))


def rank(scored: DataFrame, method: str = "first", higher_is_worse: bool = True) -> DataFrame:
    rankings = {"first": rank_first, "m": rank_mean, "v": rank_variance}
    if method not in rankings:
        raise ValueError(f"rank method must be one of {sorted(rankings)}")
    return rankings[method](scored, higher_is_worse)


def with_position(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Number all rows 1, 2, … in the given order without moving them into one task.

    A range-partitioned sort numbers the rows inside each partition; the partition sizes, one row
    each, give every partition its offset. The sorted rows are checkpointed first so that both
    passes see the same partitions.
    """
    numbered = materialise(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", ROW_BITS)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    offset, before = [], 0
    for row in sizes:
        offset += [F.lit(row["part"]), F.lit(before)]
        before += row["n"]
    if not offset:
        return numbered.withColumn(name, F.lit(0).cast("long")).drop("_row")
    inside = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    start = F.element_at(F.create_map(*offset), part).cast("long")
    return numbered.withColumn(name, (start + inside + 1).cast("long")).drop("_row")


def rank_shift(ranking: DataFrame, baseline: DataFrame, score: str = "scores", higher_is_worse: bool = True) -> DataFrame:
    """Per entity of both rankings: change of position and of absolute score against the baseline."""
    order = [worst_first(higher_is_worse, score), F.asc("entity")]
    now = with_position(ranking.select("entity", score), *order)
    then = with_position(baseline.select("entity", F.col(score).alias("_score")), *[worst_first(higher_is_worse, "_score"), F.asc("entity")], name="_position")
    return now.join(then, "entity").select(
        "entity",
        (F.col("position") - F.col("_position")).alias("position_shift"),
        (F.abs(score) - F.abs("_score")).alias("score_shift"),
    )


def mean_shift(shifts: DataFrame) -> DataFrame:
    return shifts.agg(F.avg("position_shift").alias("position_shift"), F.avg("score_shift").alias("score_shift"))
