"""Repeatable samples: the choice depends on a row's key and the seed only, never on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

HASH_RANGE = 1 << 32


def key_hash(key: Sequence[str], seed: int) -> Column:
    """Number in 0..2^32-1 from the key's text and the seed."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def split_rows(df: DataFrame, key: Sequence[str], share: float = 0.7, seed: int = 123) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts that together are the whole table; about ``share`` of the keys in the first."""
    first = key_hash(key, seed) < F.lit(int(share * HASH_RANGE))
    return df.filter(first), df.filter(~first)


def rows_per_entity(df: DataFrame, limit: int = 50, seed: int = 123, key: Sequence[str] = ("entity", "bin")) -> DataFrame:
    """At most ``limit`` random rows of every entity."""
    order = Window.partitionBy("entity").orderBy(key_hash(key, seed), *key)
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")
