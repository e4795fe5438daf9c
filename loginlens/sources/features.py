"""Storing and reloading feature and result tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loginlens.functions.timebin import clock_to_seconds, seconds_to_clock
from loginlens.schema import FEATURE_NAME_PATTERN, GROUP, KEY

FIELD_TYPES: dict[str, T.DataType] = {
    "entity": T.StringType(),
    "bin": T.LongType(),
    "weekday": T.IntegerType(),
    "day": T.DateType(),
    "hour": T.StringType(),
    GROUP: T.IntegerType(),
}


def check_feature_names(columns: list[str], extra: list[str] | None = None) -> None:
    """Refuse columns a feature table cannot have; user-defined features are named in ``extra``."""
    allowed = {*KEY, GROUP, *(extra or [])}
    unknown = [c for c in columns if c not in allowed and not re.search(FEATURE_NAME_PATTERN, c)]
    if unknown:
        raise ValueError(f"not a feature table: unexpected columns {unknown}")


def write_features(features: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Parquet, or CSV with a header and clock times written as ``HH:MM:SS``."""
    if file_format == "csv" and "hour" in features.columns:
        features = features.withColumn("hour", seconds_to_clock(F.col("hour")))
    write_table(features, path, file_format)


def read_features(spark: SparkSession, path: str, file_format: str = "parquet", extra: list[str] | None = None) -> DataFrame:
    """A stored feature table, with its columns checked and typed."""
    if file_format == "parquet":
        table = spark.read.parquet(path)
        check_feature_names(table.columns, extra)
        return table
    if file_format != "csv":
        raise ValueError("features are read from parquet or csv")
    names = spark.read.option("header", True).csv(path).columns
    check_feature_names(names, extra)
    schema = T.StructType([T.StructField(c, FIELD_TYPES.get(c, T.DoubleType())) for c in names])
    table = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    return table.withColumn("hour", clock_to_seconds(F.col("hour"))) if "hour" in names else table


def write_table(table: DataFrame, path: str, file_format: str = "parquet", header: bool = True) -> None:
    """Result and statistics tables: Parquet, CSV, or space-separated text."""
    if file_format == "parquet":
        table.write.parquet(path)
    elif file_format == "csv":
        table.write.option("header", header).csv(path)
    elif file_format == "text":
        table.write.option("header", header).option("sep", " ").csv(path)
    else:
        raise ValueError("tables are written as parquet, csv or text")
