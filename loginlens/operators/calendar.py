"""Timelines with zero-filled gaps, and the date range to analyse."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlens.functions.timebin import as_date, utc_midnight


def monthly_timeline(logons: DataFrame, ts: str = "ts") -> DataFrame:
    """Events per calendar month from the first to the last, months without events included."""
    counts = logons.groupBy(F.trunc(F.col(ts), "month").alias("period")).agg(F.count("*").alias("count"))
    return _zero_fill(counts.filter(F.col("period").isNotNull()), "interval 1 month")


def daily_timeline(logons: DataFrame, start: dt.date | str, end: dt.date | str, ts: str = "ts") -> DataFrame:
    """Events per day, both dates included."""
    first, last = as_date(start), as_date(end)
    inside = (F.col(ts) >= utc_midnight(first)) & (F.col(ts) < utc_midnight(last + dt.timedelta(days=1)))
    counts = logons.filter(inside).groupBy(F.to_date(ts).alias("period")).agg(F.count("*").alias("count"))
    days = logons.sparkSession.range((last - first).days + 1)
    calendar = days.select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("period"))
    return calendar.join(counts, "period", "left").select("period", F.coalesce("count", F.lit(0)).alias("count"))


def _zero_fill(counts: DataFrame, step: str) -> DataFrame:
    """Periods without events as zeros. The counts, one per period, travel in one row, so events are read once."""
    whole = counts.agg(
        F.map_from_entries(F.collect_list(F.struct("period", "count"))).alias("counts"),
        F.min("period").alias("lo"),
        F.max("period").alias("hi"),
    ).filter(F.col("lo").isNotNull())
    calendar = whole.select("counts", F.explode(F.sequence("lo", "hi", F.expr(step))).alias("period"))
    found = F.coalesce(F.try_element_at("counts", F.col("period")), F.lit(0).cast("long"))
    return calendar.select("period", found.alias("count"))


def busy_range(timeline: DataFrame) -> DataFrame:
    """One row (start, end): first to last month whose z-scored count lies above a high quantile.

    The quantile level is 0.90 plus 0.00019 per month, at most 1. Both dates are NULL with one month,
    equal counts or nothing above the quantile. The input has one row per month, so its arrays stay
    small at any event count.
    """
    months = F.array_sort(F.collect_list(F.struct("period", "count")))
    stats = timeline.agg(
        months.alias("months"),
        F.avg("count").alias("mean"),
        F.stddev_samp("count").alias("sd"),
        F.count("*").alias("n"),
    )
    scored = stats.withColumn(
        "z",
        F.when(F.col("sd") > 0, F.transform("months", lambda m: (m["count"] - F.col("mean")) / F.col("sd"))),
    )
    level = F.least(F.lit(1.0), F.lit(0.90) + F.col("n") * F.lit(0.00019))
    position = level * (F.col("n") - 1)
    ranked = scored.select("months", "z", F.array_sort("z").alias("s"), position.alias("at"))
    low = F.floor("at").cast("int")
    high = F.ceil("at").cast("int")
    left, right = F.get("s", low), F.get("s", high)
    border = left + (right - left) * (F.col("at") - low)
    limits = ranked.select("months", "z", border.alias("border"))
    above = F.filter(F.arrays_zip("months", "z"), lambda x: x["z"] > F.col("border"))
    hits = limits.select(F.transform(above, lambda x: x["months"]["period"]).alias("hits"))
    return hits.select(
        F.get("hits", F.lit(0)).alias("start"),
        F.add_months(F.get("hits", F.size("hits") - 1), 1).alias("end"),
    )


def full_range(logons: DataFrame, ts: str = "ts") -> DataFrame:
    """One row (start, end): first day to the day after the last."""
    return logons.agg(
        F.to_date(F.min(ts)).alias("start"), F.date_add(F.to_date(F.max(ts)), 1).alias("end")
    )


def resolve_range(
    logons: DataFrame,
    span: str = "auto",
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
) -> tuple[dt.date, dt.date]:
    """The dates to analyse, on the events as read: given dates, the full span or the busy months.

    Without busy months the full span is taken.
    """
    if start is not None or end is not None:
        if start is None or end is None:
            raise ValueError("give both dates or none")
        first, last = as_date(start), as_date(end)
        if first > last:
            raise ValueError("the start date lies after the end date")
        return first, last
    if span not in ("auto", "full"):
        raise ValueError("span must be auto or full")
    row = busy_range(monthly_timeline(logons)).first() if span == "auto" else None
    if row is None or row["start"] is None:
        row = full_range(logons).first()
    if row is None or row["start"] is None:
        raise ValueError("no events to take a date range from")
    return row["start"], row["end"]
