"""Weighted rendezvous hashing of record keys, with positions inside the shards; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loginlens.llm.common import stored

#: Rows of one slice of a shard, in which positions are counted one after the other.
SLICE_ROWS = 20_000


def uniform(key: Column, shard: int, seed: str) -> Column:
    """A number in (0, 1) that depends on key, shard and seed alone. A null key is a key of its own."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}:{shard}"), key, F.isnull(key)), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def shard_of(key: Column, weights: Sequence[float], seed: str = "shard") -> Column:
    """The shard whose score -weight / ln(uniform) is largest; shards of weight 0 get nothing, ties go to the smaller.

    A shard's score depends on no other shard. So a new shard takes rows only into itself, and a raised weight moves
    rows only to that shard.
    """
    if not any(w > 0 for w in weights) or min(weights) < 0:
        raise ValueError("weights must not be negative, and one must be positive")
    scores = [F.struct((F.lit(float(w)) / -F.ln(uniform(key, i, seed))).alias("score"), F.lit(-i).alias("minus")) for i, w in enumerate(weights) if w > 0]
    return (-F.array_max(F.array(*scores))["minus"]).cast("int")


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard", seed: str = "shard") -> DataFrame:
    """All rows and columns with their shard; a column named like ``shard`` is replaced. Equal keys share a shard."""
    return df.withColumn(shard, shard_of(F.col(key), weights, seed))


def number_in_shards(df: DataFrame, order: Sequence[str], shard: str = "shard", slot: str = "slot") -> DataFrame:
    """All rows with their position in their shard, from 0 without gaps.

    Shards are cut into slices by a hash of the ``order`` columns, sized from the counted rows, so that no task orders
    a whole shard; a slice starts where the ones before it end. The positions within a slice follow ``order``; rows that
    agree in all of it are interchangeable. ``df`` is written once to the shared folder, as it is read twice.
    """
    spark = df.sparkSession
    df = stored(df, "shards")
    rows = df.count()
    if rows == 0:
        return df.withColumn(slot, F.lit(0).cast("long"))
    shards = max(1, df.agg(F.approx_count_distinct(shard)).first()[0])
    slices = max(1, -(-rows // (shards * SLICE_ROWS)), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) * 2 // shards))
    cut = df.withColumn("__slice", F.pmod(F.xxhash64(F.lit("slice"), *[F.col(c) for c in order]), F.lit(slices)))
    counts = cut.groupBy(shard, "__slice").agg(F.count("*").alias("__n"))
    # One row for each slice of a shard.
    before = Window.partitionBy(shard).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(shard, "__slice").orderBy(*order)
    numbered = cut.withColumn("__row", F.row_number().over(inside))
    joined = numbered.join(starts, [shard, "__slice"])
    return joined.select(*[c for c in df.columns if c != slot], (F.col("__start") + F.col("__row") - 1).cast("long").alias(slot))
