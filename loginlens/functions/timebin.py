"""Time bins anchored at midnight of the start date, and the features of a bin's position."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql.column import Column

MICROS_PER_HOUR = 3_600_000_000


def as_date(value: dt.date | dt.datetime | str) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


@dataclass(frozen=True)
class TimeBin:
    """``d`` = one day; ``h`` and ``dh`` = 1 to 72 hours, without and with the date as a feature."""

    kind: str = "d"
    hours: int = 1
    use_date: bool = False

    def __post_init__(self) -> None:
        if self.kind not in ("d", "h", "dh"):
            raise ValueError("time bin must be d, h or dh")
        if not 1 <= self.hours <= 72:
            raise ValueError("a bin covers 1 to 72 hours")

    @property
    def width_hours(self) -> int:
        return 24 if self.kind == "d" else self.hours

    @property
    def width_micros(self) -> int:
        return self.width_hours * MICROS_PER_HOUR

    def count(self, start: dt.date, end: dt.date) -> int:
        """Number of bins that cover ``[start, end)``; the last one may reach past ``end``."""
        hours = (as_date(end) - as_date(start)).days * 24
        return max(1, -(-hours // self.width_hours))

    def stop(self, start: dt.date, end: dt.date) -> dt.datetime:
        """Exclusive end of the last bin."""
        midnight = dt.datetime.combine(as_date(start), dt.time())
        return midnight + dt.timedelta(hours=self.count(start, end) * self.width_hours)

    def index(self, ts: Column, start: dt.date) -> Column:
        elapsed = F.unix_micros(ts) - F.unix_micros(utc_midnight(start))
        return F.floor(elapsed / F.lit(self.width_micros)).cast("long")

    def features(self, start: dt.date, bin_index: Column | None = None) -> dict[str, Column]:
        """Time features as expressions over the bin number."""
        index = F.col("bin") if bin_index is None else bin_index
        first_hour = index * F.lit(self.width_hours)
        day = F.date_add(F.lit(as_date(start)), F.floor(first_hour / F.lit(24)).cast("int"))
        hour = (F.pmod(first_hour, F.lit(24)) * F.lit(3600)).cast("int")
        if self.kind == "h":
            return {"hour": hour}
        if self.kind == "dh":
            return {"day": day, "hour": hour}
        return {"day": day} if self.use_date else {"weekday": (F.weekday(day) + 1).cast("int")}


def utc_midnight(day: dt.date | str) -> Column:
    return F.lit(f"{as_date(day).isoformat()} 00:00:00").cast("timestamp")


def utc_timestamp(moment: dt.datetime) -> Column:
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def clock_to_seconds(text: Column) -> Column:
    """``HH:MM:SS`` text as seconds since midnight."""
    parts = F.split(text, ":")
    return (
        parts.getItem(0).cast("int") * 3600 + parts.getItem(1).cast("int") * 60 + parts.getItem(2).cast("int")
    ).cast("int")


def seconds_to_clock(seconds: Column) -> Column:
    """Seconds since midnight as ``HH:MM:SS`` text, for sinks that people read."""
    hours = F.floor(seconds / 3600).cast("string")
    minutes = F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("string")
    rest = F.pmod(seconds, F.lit(60)).cast("int").cast("string")
    return F.concat_ws(":", *[F.lpad(part, 2, "0") for part in (hours, minutes, rest)])


def days_since_1900(day: Column) -> Column:
    return F.datediff(day, F.lit("1900-01-01").cast("date"))
