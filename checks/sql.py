"""SQL building blocks: the same tables the queries use, for DuckDB."""

from __future__ import annotations

from checks.tables import LOGONS_SQL

COUNTS = {
    "user": ("account", ("Hosts_per_User", "host"), ("Sources_per_User", "source")),
    "host": ("host", ("Users_per_Host", "account"), ("Sources_per_Host", "source")),
    "source": ("source", ("Users_per_Source", "account"), ("Hosts_per_Source", "host")),
}
SETS = [(2,), (3,), (9,), (10,), (11, 12)]

SPAN = """
span as (select date_trunc('day', min(ts)) as lo, date_trunc('day', max(ts)) + interval 1 day as hi from events)"""
KEPT = "\nkept as (select * from logons where event_code = 4624)"
IGNORED = """coalesce(try_cast(account as bigint) between 0 and 10000
                 and cast(try_cast(account as bigint) as varchar) = account, false)"""
CLEAN = f"""
clean as (select distinct event_code, host, ts, account, source, source_port, logon_type
          from kept where not {IGNORED})"""
BASE = [LOGONS_SQL, KEPT, CLEAN, SPAN]


def query(select: str, *ctes: str) -> str:
    return "with " + ",".join(ctes) + "\n" + select


def proportion(types: tuple[int, ...]) -> str:
    name = "proportion_" + "_".join(map(str, types))
    inside = ", ".join(map(str, types))
    return f"cast(sum(case when logon_type in ({inside}) then 1 else 0 end) as double) / count(*) as {name}"


def distinct(column: str) -> str:
    return f"cast(count(distinct {column}) + max(case when {column} is null then 1 else 0 end) as bigint)"


def features(
    view: str = "user",
    kind: str = "d",
    hours: int = 1,
    use_date: bool = False,
    source: str = "clean",
    name: str = "feat",
    sets: list[tuple[int, ...]] = SETS,
    extra: str = "",
    clip: bool = False,
) -> str:
    """CTEs ``<name>_binned`` and ``<name>``: the feature table of a cleaned event table."""
    width = 24 if kind == "d" else hours
    micros = width * 3_600_000_000
    key, *counted = COUNTS[view]
    bins = f"cast(ceil(date_diff('day', lo, hi) * 24 / {width}.0) as bigint)"
    stop = "epoch_us(hi)" if clip else f"epoch_us(lo) + {bins} * {micros}"
    day = f"cast(lo + to_hours(cast(bin * {width} as bigint)) as date)"
    hour = f"cast((bin * {width}) % 24 * 3600 as int) as hour"
    if kind == "h":
        time = hour
    elif kind == "dh":
        time = f"cast({day} as varchar) as day, {hour}"
    else:
        time = f"cast({day} as varchar) as day" if use_date else f"cast(isodow({day}) as int) as weekday"
    columns = ",\n       ".join(
        ["count(*) as number_events"]
        + [proportion(s) for s in sets]
        + [
            """case when count(*) = 1 then 0.0::double when max(ts) = min(ts) then 1.0::double
            else count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::double) end as events_per_second"""
        ]
        + [f"{distinct(column)} as {label}" for label, column in counted]
    )
    return f"""
{name}_binned as (select {key} as entity, (epoch_us(ts) - epoch_us(lo)) // {micros} as bin, lo, host, account, source,
                  source_port, logon_type, ts
           from {source}, span where {key} is not null and ts >= lo and epoch_us(ts) < {stop}),
{name} as (select entity, bin, {time}, {columns}{extra}
  from {name}_binned group by entity, bin, lo)"""


NUMERIC = [
    "number_events", "proportion_2", "proportion_3", "proportion_9", "proportion_10", "proportion_11_12",
    "events_per_second", "Hosts_per_User", "Sources_per_User",
]

NORMALISED = f"""
norm as (select entity, bin, weekday, {", ".join(
    f"case when max({c}) over () = min({c}) over () then 0.5::double else ({c} - min({c}) over ())::double / (max({c}) over () - min({c}) over ())::double end as {c}"
    for c in NUMERIC)} from feat)"""


def nearest(points: str, key: str, pair: str, k: int, include_self: bool, how: str = "mean") -> str:
    """SELECT with (key, scores): aggregate of the k smallest distances, by brute force."""
    skip = "" if include_self else f"where a.{key} <> b.{key}"
    score = {
        "mean": "list_sum(near) / len(near)",
        "largest": "near[-1]",
        "median": "(near[cast(floor((len(near) + 1) / 2.0) as int)] + near[len(near) + 1 - cast(floor((len(near) + 1) / 2.0) as int)]) / 2",
    }[how]
    return f"""select {key}, round({score}, 6) as scores from (
      select a.{key} as {key}, min({pair}, {k}) as near from {points} a, {points} b {skip} group by a.{key}) t"""
