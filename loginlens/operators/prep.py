"""Cleaning of raw events: filters, deduplication, scenario edits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from loginlens.functions.timebin import utc_midnight
from loginlens.schema import DEDUP_COLUMNS, LOGON_EVENT_CODE, view_column
from loginlens.session import broadcast_if_bounded


def keep_events(logons: DataFrame, event_code: int = LOGON_EVENT_CODE) -> DataFrame:
    return logons.filter(F.col("event_code") == event_code)


def in_range(logons: DataFrame, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """Events of ``[start, end)``; literal bounds, so the scan can skip row groups."""
    return logons.filter((F.col("ts") >= utc_midnight(start)) & (F.col("ts") < utc_midnight(end)))


def is_ignored_account(account: Column, first: int, last: int) -> Column:
    """True when the text is exactly that of an integer in ``first..last`` (``0010`` and names are not)."""
    number = account.try_cast("long")
    return F.coalesce(number.between(first, last) & (number.cast("string") == account), F.lit(False))


def drop_ignored_accounts(logons: DataFrame, first: int = 0, last: int = 10_000) -> DataFrame:
    return logons.filter(~is_ignored_account(F.col("account"), first, last))


def deduplicate(logons: DataFrame) -> DataFrame:
    """Distinct events over every column but the logon id."""
    return logons.select(DEDUP_COLUMNS).distinct()


def clean(logons: DataFrame, ignore_accounts: tuple[int, int] | None = (0, 10_000)) -> DataFrame:
    kept = drop_ignored_accounts(logons, *ignore_accounts) if ignore_accounts else logons
    return deduplicate(kept)


def with_entity(logons: DataFrame, view: str) -> DataFrame:
    """Add the view's key as ``entity``; events without one belong to no row and are left out."""
    key = view_column(view)
    return logons.filter(F.col(key).isNotNull()).withColumn("entity", F.col(key))


def well_known_ports(logons: DataFrame) -> DataFrame:
    """Events from source ports 1 to 1023."""
    return logons.filter(F.col("source_port").between(1, 1023))


def remove_activity(
    logons: DataFrame, accounts: DataFrame, start: dt.date | str, end: dt.date | str, keep_listed: bool = False
) -> DataFrame:
    """Drop the listed accounts' events of ``[start, end)``; with ``keep_listed`` drop everyone else's."""
    inside = (F.col("ts") >= utc_midnight(start)) & (F.col("ts") < utc_midnight(end))
    marked = _mark(logons, accounts)
    hit = ~F.col("_listed") if keep_listed else F.col("_listed")
    return marked.filter(~(hit & F.coalesce(inside, F.lit(False)))).drop("_listed")


def shift_activity(logons: DataFrame, accounts: DataFrame, start: dt.date | str, hours: int) -> DataFrame:
    """Move the listed accounts' events from ``start`` on by some hours (a site changing its clock)."""
    marked = _mark(logons, accounts)
    moved = F.col("_listed") & (F.col("ts") >= utc_midnight(start))
    later = F.timestamp_micros(F.unix_micros("ts") + F.lit(hours * 3_600_000_000))
    return marked.withColumn("ts", F.when(moved, later).otherwise(F.col("ts"))).drop("_listed")


def add_activity(logons: DataFrame, extra: DataFrame) -> DataFrame:
    return logons.unionByName(extra)


def _mark(logons: DataFrame, accounts: DataFrame) -> DataFrame:
    listed = accounts.select("account").distinct().withColumn("_hit", F.lit(True))
    return logons.join(broadcast_if_bounded(listed), "account", "left").withColumn("_listed", F.coalesce("_hit", F.lit(False))).drop("_hit")
