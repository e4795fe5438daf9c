"""Descriptive statistics of raw or cleaned events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loginlens.operators.calendar import daily_timeline, monthly_timeline
from loginlens.operators.features import distinct_with_null
from loginlens.operators.prep import well_known_ports

LOGON_TYPES = 14


def logon_type_counts(logons: DataFrame) -> DataFrame:
    """Events per logon type 0 to 13, types without events included."""
    counts = logons.groupBy("logon_type").agg(F.count("*").alias("count"))
    types = logons.sparkSession.range(LOGON_TYPES).select(F.col("id").cast("int").alias("logon_type"))
    return types.join(counts, "logon_type", "left").select("logon_type", F.coalesce("count", F.lit(0)).alias("count"))


def general_infos(logons: DataFrame) -> DataFrame:
    """One row: numbers of hosts, users and sources (NULL is one of them), first and last time."""
    return logons.agg(
        distinct_with_null("host").alias("hosts"),
        distinct_with_null("account").alias("users"),
        distinct_with_null("source").alias("sources"),
        F.min("ts").alias("first_event"),
        F.max("ts").alias("last_event"),
    )


def well_known_port_counts(logons: DataFrame) -> DataFrame:
    """Source ports 1 to 1023 in use, with their numbers of events."""
    return well_known_ports(logons).groupBy("source_port").agg(F.count("*").alias("count"))


def top_accounts_per_type(logons: DataFrame, top: int = 5) -> DataFrame:
    """Per logon type the accounts with the largest shares of its events."""
    per_account = logons.filter(F.col("logon_type").isNotNull()).groupBy("logon_type", "account").agg(
        F.count("*").alias("n")
    )
    totals = per_account.groupBy("logon_type").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("logon_type").orderBy(F.desc("n"), F.asc_nulls_last("account"))
    best = per_account.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    return best.join(totals, "logon_type").select("logon_type", "place", "account", (F.col("n") / F.col("total")).alias("share"))


def data_statistics(logons: DataFrame, start: dt.date | str, end: dt.date | str) -> dict[str, DataFrame]:
    """All statistics tables by name; call it on raw and on cleaned events to compare them."""
    return {
        "general_infos": general_infos(logons),
        "well_known_ports": well_known_port_counts(logons),
        "logon_types": logon_type_counts(logons),
        "months": monthly_timeline(logons),
        "days": daily_timeline(logons, start, end),
        "top_accounts": top_accounts_per_type(logons),
    }
