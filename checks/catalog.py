"""Every registered query with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import sql as S
from checks.tables import dates, logons, table
from loginlens.functions import scaling
from loginlens.functions.timebin import TimeBin, clock_to_seconds, days_since_1900, seconds_to_clock
from loginlens.operators import calendar, forest, grouping, normalise, prep, profile, rank, sampling, stats
from loginlens.operators.features import Feature, FeatureRegistry, append_features, entities, extract_features
from loginlens.operators.rollup import features_of_totals, mergeable_totals, roll_up
from loginlens.operators.iforest import IsolationForestDetector
from loginlens.operators.knn import KNNDetector, knn_pairs
from loginlens.operators.lsh import approximate_knn_search
from loginlens.operators.lscp import LSCPDetector, pick_locally
from loginlens.operators.em import Mixture, em_step
from loginlens.operators.mixture import MixtureEnergyDetector, add_energy
from loginlens.plans.analysis import Models, Options, find_anomalies, group_drift, group_features
from loginlens.session import materialise, new_shared_path, use_utc
from loginlens.sources.features import read_features, write_features
from loginlens.sources.logons import parse_logon_id, parse_time, read_logons, write_by_time, write_logons
from loginlens.streaming.features import (
    clean_stream,
    end_stream,
    read_stream_output,
    stream_features,
    stream_logons,
    write_stream,
)
from loginlens.streaming.score import scorer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        label = name or run.__name__

        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(run(use_utc(spark), sf_dir))

        in_utc.__name__ = label
        QUERIES[label] = in_utc
        if sql is not None:
            ORACLES[label] = sql
        return run

    return add


def plain(df: DataFrame) -> DataFrame:
    """Dates as text and times as microseconds, so that both engines return the same values."""
    columns = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            columns.append(F.col(f.name).cast("string").alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            columns.append(F.unix_micros(f.name).alias(f.name))
        else:
            columns.append(F.col(f.name))
    return df.select(columns)


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Sums of doubles depend on their order in the last bits; compare what is left of that."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.keep_events(logons(spark, sf_dir))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.clean(kept(spark, sf_dir))


def feature_table(spark: SparkSession, sf_dir: str, view: str = "user", time_bin: TimeBin = TimeBin(), **how) -> DataFrame:
    return extract_features(cleaned(spark, sf_dir), *dates(spark, sf_dir), view, time_bin, **how)


FEAT = [*S.BASE, S.features()]
TS = "epoch_us(ts) as ts"

# --- sources -------------------------------------------------------------------------------------

LOGON_ROWS = f"select event_code, host, {TS}, logon_id, account, source, source_port, logon_type from kept"


@register(S.query(LOGON_ROWS, *S.BASE[:2]))
def logons_csv(spark, sf_dir):
    """Headerless CSV written and read back."""
    path = new_shared_path(spark, "logons-csv") + ".csv"
    write_logons(logons(spark, sf_dir), path, "csv")
    return read_logons(spark, path)


@register(S.query(LOGON_ROWS, *S.BASE[:2]))
def logons_parquet_by_time(spark, sf_dir):
    """The time-ordered layout read back."""
    path = new_shared_path(spark, "logons-by-time")
    write_by_time(logons(spark, sf_dir), path)
    return read_logons(spark, path)


FIVE_HOURS = [*S.BASE, S.features("user", "dh", 5)]


@register(S.query("select * from feat", *FIVE_HOURS))
def features_reloaded_csv(spark, sf_dir):
    path = new_shared_path(spark, "features-csv")
    write_features(feature_table(spark, sf_dir, time_bin=TimeBin("dh", 5)), path, "csv")
    table = read_features(spark, path, "csv")
    counts = ["number_events", "Hosts_per_User", "Sources_per_User"]
    return table.withColumns({c: F.col(c).cast("long") for c in counts})


@register(S.query("select * from feat", *FIVE_HOURS))
def features_reloaded_parquet(spark, sf_dir):
    path = new_shared_path(spark, "features")
    write_features(feature_table(spark, sf_dir, time_bin=TimeBin("dh", 5)), path)
    return read_features(spark, path)


@register("select event_id, epoch_us(ts) as parsed_ts, event_id as parsed_id from events")
def parsed_text_fields(spark, sf_dir):
    """Times with a UTC suffix and hexadecimal ids, from text."""
    text = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" UTC")).alias("t"),
        F.concat(F.lit("0x"), F.hex("event_id")).alias("x"),
    )
    return text.select("event_id", parse_time(F.col("t")).alias("parsed_ts"), parse_logon_id(F.col("x")).alias("parsed_id"))


# --- filters and cleaning ------------------------------------------------------------------------


@register(S.query("select account, count(*) as n from kept group by account", *S.BASE[:2]))
def successful_logons(spark, sf_dir):
    return kept(spark, sf_dir).groupBy("account").agg(F.count("*").alias("n"))


@register(
    S.query(
        "select account, count(*) as n from kept, span where ts >= lo + interval 7 day and ts < lo + interval 14 day group by account",
        *S.BASE,
    )
)
def logons_in_range(spark, sf_dir):
    first = dates(spark, sf_dir)[0]
    week = prep.in_range(kept(spark, sf_dir), first + _days(7), first + _days(14))
    return week.groupBy("account").agg(F.count("*").alias("n"))


def _days(n: int):
    import datetime as dt

    return dt.timedelta(days=n)


@register(S.query(f"select account, count(*) as n from kept where not {S.IGNORED} group by account", *S.BASE[:2]))
def without_ignored_accounts(spark, sf_dir):
    return prep.drop_ignored_accounts(kept(spark, sf_dir)).groupBy("account").agg(F.count("*").alias("n"))


@register(S.query(f"select event_code, host, {TS}, account, source, source_port, logon_type from clean", *S.BASE[:3]))
def deduplicated_logons(spark, sf_dir):
    return cleaned(spark, sf_dir)


@register(S.query("select source as entity, count(*) as n from clean where source is not null group by source", *S.BASE[:3]))
def logons_with_source(spark, sf_dir):
    """The source view leaves out events without a source."""
    return prep.with_entity(cleaned(spark, sf_dir), "source").groupBy("entity").agg(F.count("*").alias("n"))


# --- features ------------------------------------------------------------------------------------

for label, view, how in [
    ("features_user_day", "user", {}),
    ("features_user_date", "user", {"use_date": True}),
    ("features_user_hour", "user", {"kind": "h", "hours": 1}),
    ("features_host_5h", "host", {"kind": "h", "hours": 5}),
    ("features_host_day", "host", {}),
    ("features_source_72h_date", "source", {"kind": "dh", "hours": 72}),
    ("features_source_day", "source", {}),
    ("features_user_7h_date", "user", {"kind": "dh", "hours": 7}),
]:

    @register(S.query("select * from feat", *S.BASE, S.features(view, **how)), label)
    def _features(spark, sf_dir, view=view, how=how):
        return feature_table(spark, sf_dir, view, TimeBin(**{"kind": "d", **how}))


@register(S.query("select * from feat", *S.BASE, S.features("user", "h", 7, clip=True)))
def features_user_7h_clipped(spark, sf_dir):
    return feature_table(spark, sf_dir, time_bin=TimeBin("h", 7), clip_end=True)


@register(
    S.query(
        "select * from feat",
        *S.BASE,
        S.features(
            sets=[(2, 3), (9,)],
            extra=""",
       cast(count(distinct source_port) as bigint) as ports, max(logon_type) as highest_type""",
        ),
    )
)
def features_user_defined(spark, sf_dir):
    """Own proportion sets and two registered features."""
    registry = FeatureRegistry()
    registry.add(Feature("ports", F.count_distinct("source_port")))
    registry.add(Feature("highest_type", F.max("logon_type"), normalise=False, in_means=False))
    return feature_table(spark, sf_dir, proportions=[(2, 3), (9,)], registry=registry)


@register(S.query("select * from feat", *FEAT))
def appended_features(spark, sf_dir):
    """Two halves of the range extracted apart and appended."""
    first, last = dates(spark, sf_dir)
    middle = first + _days((last - first).days // 2)
    events = cleaned(spark, sf_dir)
    late = extract_features(events, middle, last)
    return append_features(
        extract_features(events, first, middle), late.withColumn("bin", F.col("bin") + (middle - first).days)
    )


@register(S.query("select distinct entity from feat", *FEAT))
def feature_entities(spark, sf_dir):
    return entities(feature_table(spark, sf_dir))


@register(
    S.query(
        """select entity, bin, date_diff('day', date '1900-01-01', cast(day as date)) as day_number, hour as seconds,
           lpad(cast(hour // 3600 as varchar), 2, '0') || ':00:00' as clock from feat""",
        *FIVE_HOURS,
    )
)
def time_feature_values(spark, sf_dir):
    """Dates and clock times as the numbers models are given, and back."""
    features = feature_table(spark, sf_dir, time_bin=TimeBin("dh", 5)).withColumn("clock", seconds_to_clock(F.col("hour")))
    return features.select(
        "entity",
        "bin",
        days_since_1900(F.col("day")).cast("long").alias("day_number"),
        clock_to_seconds(F.col("clock")).alias("seconds"),
        "clock",
    )


@register(S.query("select entity, bin, row_number() over (partition by entity order by bin) - 1 as sequence from feat", *FEAT))
def row_sequence(spark, sf_dir):
    return forest.row_sequence(feature_table(spark, sf_dir)).select("entity", "bin", "sequence")


# --- means, bounds, scaling ----------------------------------------------------------------------

MEANS = ", ".join(f"round(avg({c}::double), 9) as {c}" for c in S.NUMERIC)
RAW_MEANS = "means as (select entity, " + ", ".join(f"avg({c}::double) as {c}" for c in S.NUMERIC) + " from feat group by entity)"


@register(S.query(f"select entity, {MEANS} from feat group by entity", *FEAT))
def entity_means(spark, sf_dir):
    return rounded(normalise.entity_means(feature_table(spark, sf_dir)), *S.NUMERIC)


def bounds_sql(source: str = "feat") -> str:
    return "\nunion all ".join(
        f"select '{c}' as feature, min({c})::double as min, max({c})::double as max from {source}" for c in S.NUMERIC
    )


@register(S.query(bounds_sql(), *FEAT))
def feature_bounds(spark, sf_dir):
    return normalise.min_max_table(spark, normalise.min_max(feature_table(spark, sf_dir)))


@register(S.query(bounds_sql(), *FEAT))
def merged_bounds(spark, sf_dir):
    """Stored bounds of the first half of the time range widened by those of the second."""
    first, last = dates(spark, sf_dir)
    middle = first + _days((last - first).days // 2)
    events = cleaned(spark, sf_dir)
    halves = [normalise.min_max(extract_features(events, a, b)) for a, b in ((first, middle), (middle, last))]
    return normalise.min_max_table(spark, normalise.merge_min_max(*halves))


@register(S.query("select entity, bin, weekday, " + ", ".join(f"round({c}, 9) as {c}" for c in S.NUMERIC) + " from norm", *FEAT, S.NORMALISED))
def normalised_features(spark, sf_dir):
    return rounded(normalise.normalise(feature_table(spark, sf_dir)), *S.NUMERIC)


@register(
    S.query(
        "select entity, bin, " + ", ".join(f"case when weekday = {d} then 1.0::double else 0.0::double end as weekday_{d}" for d in range(1, 8)) + " from feat",
        *FEAT,
    )
)
def one_hot_weekday(spark, sf_dir):
    days = list(range(1, 8))
    hot = scaling.one_hot(feature_table(spark, sf_dir), "weekday", days, "weekday")
    return hot.select("entity", "bin", *[f"weekday_{d}" for d in days])


@register(
    S.query(
        "select entity, bin, " + ", ".join(f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) as {c}" for c in S.NUMERIC) + " from feat",
        *FEAT,
    )
)
def standardised_features(spark, sf_dir):
    table = scaling.standardise(feature_table(spark, sf_dir), S.NUMERIC)
    return rounded(table.select("entity", "bin", *S.NUMERIC), *S.NUMERIC, digits=6)


@register(
    S.query(
        """select entity, round(ln(number_events), 9) as log_events, round((pow(Hosts_per_User, 0.5) - 1) / 0.5, 9) as root_hosts,
           round((pow(Sources_per_User, -1.5) - 1) / -1.5, 9) as inverse_sources from means""",
        *FEAT,
        RAW_MEANS,
    )
)
def box_cox_given_exponents(spark, sf_dir):
    means = normalise.entity_means(feature_table(spark, sf_dir))
    table = means.select(
        "entity",
        scaling.box_cox(F.col("number_events"), 0.0).alias("log_events"),
        scaling.box_cox(F.col("Hosts_per_User"), 0.5).alias("root_hosts"),
        scaling.box_cox(F.col("Sources_per_User"), -1.5).alias("inverse_sources"),
    )
    return rounded(table, "log_events", "root_hosts", "inverse_sources")


@register(
    S.query(
        """select feature, lam from (
             select feature, lam, row_number() over (partition by feature order by ll desc, lam) as place from (
               select feature, lam, n * (-ln(v) / 2 + (lam - 1) * logs) as ll from (
                 select feature, lam, count(*) as n, avg(ln(x)) as logs,
                        var_pop(case when lam = 0 then ln(x) else (pow(x, lam) - 1) / lam end) as v
                 from values_ cross join (select (i - 20) / 10.0::double as lam from range(41) r(i)) l
                 where feature in (select feature from values_ group by feature having min(x) > 0 and count(distinct x) > 2)
                 group by feature, lam) a where v > 0) b) c where place = 1""",
        *FEAT,
        RAW_MEANS,
        "values_ as (" + " union all ".join(f"select '{c}' as feature, {c} as x from means" for c in S.NUMERIC) + ")",
    )
)
def box_cox_exponents(spark, sf_dir):
    """Exponents of highest likelihood for the entity means."""
    means = normalise.entity_means(feature_table(spark, sf_dir))
    found = scaling.box_cox_lambdas(means, S.NUMERIC)
    return spark.createDataFrame(list(found.items()), "feature string, lam double")


# --- groups --------------------------------------------------------------------------------------

GIVEN_GROUP = "cast(1 + cast(entity as bigint) % 13 as int)"


def given_groups(features: DataFrame) -> DataFrame:
    return entities(features).withColumn("group_id", (1 + F.col("entity").cast("long") % 13).cast("int"))


@register(S.query(f"select *, {GIVEN_GROUP} as group_id from feat", *FEAT))
def features_with_group(spark, sf_dir):
    features = feature_table(spark, sf_dir)
    return grouping.attach_group(features, given_groups(features))


@register(
    S.query(
        "select group_id, count(*)::double / sum(count(*)) over () as weight from (select distinct entity, "
        + GIVEN_GROUP
        + " as group_id from feat) t group by group_id",
        *FEAT,
    )
)
def group_shares(spark, sf_dir):
    return grouping.group_weights(given_groups(feature_table(spark, sf_dir)))


@register(S.query("select entity, count(distinct Hosts_per_User) as visited_groups from feat group by entity", *FEAT))
def visited_groups(spark, sf_dir):
    """The number of hosts stands in for the group a row behaves like."""
    rows = feature_table(spark, sf_dir).withColumn("group_id", F.col("Hosts_per_User").cast("int"))
    return grouping.visited_groups(rows)


@register(S.query("select * from feat", *S.BASE, S.features("user", "dh", 24)))
def features_from_sketches(spark, sf_dir):
    """Stored totals of six-hour bins with distinct-count sketches, rolled up to 24 hours; counts this small are exact."""
    start, end = dates(spark, sf_dir)
    hours, day = TimeBin("dh", 6), TimeBin("dh", 24)
    path = new_shared_path(spark, "totals")
    mergeable_totals(cleaned(spark, sf_dir), start, end, "user", hours).write.parquet(path)
    return features_of_totals(roll_up(spark.read.parquet(path), hours, day), start, "user", day)


@register(
    S.query(
        """select entity, cast(sum(case when g <> before then 1 else 0 end) as bigint) as changed_groups from (
           select entity, Hosts_per_User as g, lag(Hosts_per_User) over (partition by entity order by bin) as before from feat) t
           group by entity""",
        *FEAT,
    )
)
def changed_groups(spark, sf_dir):
    rows = feature_table(spark, sf_dir).withColumn("group_id", F.col("Hosts_per_User").cast("int"))
    return forest.changed_groups(rows)


@register()
def kmeans_groups(spark, sf_dir):
    means = normalise.entity_means(feature_table(spark, sf_dir))
    return grouping.fit_groups(means).assign(means).select("entity", "group_id")


@register()
def kmeans_groups_of_later_entities(spark, sf_dir):
    """Groups fitted on the first half of the range, entities of the second assigned to them."""
    first, last = dates(spark, sf_dir)
    middle = first + _days((last - first).days // 2)
    events = cleaned(spark, sf_dir)
    early, late = (normalise.entity_means(extract_features(events, a, b)) for a, b in ((first, middle), (middle, last)))
    return grouping.fit_groups(early).assign(late).select("entity", "group_id")


@register()
def spectral_groups(spark, sf_dir):
    means = materialise(normalise.entity_means(feature_table(spark, sf_dir)))
    return grouping.spectral_groups(means, k=5 if means.count() > 20 else 2)


# --- statistics ----------------------------------------------------------------------------------


@register(
    S.query(
        """select cast(t as int) as logon_type, count(logon_type) as count from range(14) r(t)
           left join kept on logon_type = t group by t""",
        *S.BASE[:2],
    )
)
def logon_type_counts(spark, sf_dir):
    return stats.logon_type_counts(kept(spark, sf_dir))


INFOS = f"""select {S.distinct("host")} as hosts, {S.distinct("account")} as users, {S.distinct("source")} as sources,
  epoch_us(min(ts)) as first_event, epoch_us(max(ts)) as last_event from """


@register(S.query(INFOS + "kept", *S.BASE[:2]))
def general_infos(spark, sf_dir):
    return stats.general_infos(kept(spark, sf_dir))


@register(S.query(INFOS + "clean", *S.BASE[:3]))
def general_infos_cleaned(spark, sf_dir):
    return stats.data_statistics(cleaned(spark, sf_dir), *dates(spark, sf_dir))["general_infos"]


@register(S.query("select source_port, count(*) as count from kept where source_port between 1 and 1023 group by source_port", *S.BASE[:2]))
def well_known_ports(spark, sf_dir):
    return stats.well_known_port_counts(kept(spark, sf_dir))


MONTHS = """
counts as (select date_trunc('month', o_orderdate)::date as period, count(*) as n from orders group by 1),
months as (select m::date as period, coalesce(n, 0) as count
           from (select unnest(generate_series((select min(period) from counts), (select max(period) from counts), interval 1 month)) as m) c
           left join counts on counts.period = c.m::date)"""


@register(S.query("select cast(period as varchar) as period, count from months", MONTHS))
def monthly_orders(spark, sf_dir):
    """Month timeline, on the table that covers several years."""
    return calendar.monthly_timeline(table(spark, sf_dir, "orders"), "o_orderdate")


@register(S.query("select cast(date_trunc('month', ts)::date as varchar) as period, count(*) as count from kept group by 1", *S.BASE[:2]))
def monthly_logons(spark, sf_dir):
    return calendar.monthly_timeline(kept(spark, sf_dir))


@register(
    S.query(
        """select cast(d::date as varchar) as period, count(ts) as count
           from (select unnest(generate_series(lo, hi, interval 1 day)) as d from span) c
           left join kept on ts >= d and ts < d + interval 1 day group by d""",
        *S.BASE,
    )
)
def daily_logons(spark, sf_dir):
    """Both dates included, so the last day is empty."""
    return calendar.daily_timeline(kept(spark, sf_dir), *dates(spark, sf_dir))


@register(
    S.query(
        """select cast(min(period) as varchar) as start, cast((max(period) + interval 1 month)::date as varchar) as "end" from scored
           where z > (select max(case when place = floor(pos) then z end) + (max(case when place = ceil(pos) then z end)
                      - max(case when place = floor(pos) then z end)) * (max(pos) - floor(max(pos))) from scored)""",
        MONTHS,
        "scores as (select period, (count - avg(count) over ()) / stddev_samp(count) over () as z from months)",
        """scored as (select *, row_number() over (order by z) - 1 as place,
                     least(1.0, 0.90 + count(*) over () * 0.00019) * (count(*) over () - 1) as pos from scores)""",
    )
)
def busy_range_orders(spark, sf_dir):
    return calendar.busy_range(calendar.monthly_timeline(table(spark, sf_dir, "orders"), "o_orderdate"))


@register(S.query('select cast(lo::date as varchar) as start, cast(hi::date as varchar) as "end" from span', S.SPAN))
def full_range_logons(spark, sf_dir):
    return calendar.full_range(logons(spark, sf_dir))


@register(
    S.query(
        """select logon_type, place, account, n::double / total as share from (
             select logon_type, account, n, sum(n) over (partition by logon_type) as total,
                    cast(row_number() over (partition by logon_type order by n desc, account) as int) as place
             from (select logon_type, account, count(*) as n from kept where logon_type is not null group by 1, 2) a) b
           where place <= 5""",
        *S.BASE[:2],
    )
)
def top_accounts_per_type(spark, sf_dir):
    return stats.top_accounts_per_type(kept(spark, sf_dir))


# --- rankings on a given score -------------------------------------------------------------------


def scored(spark, sf_dir):
    """Events per second stand in for a detector's score; rows with eight events or more are flagged."""
    rows = feature_table(spark, sf_dir).withColumn("scores", F.col("events_per_second"))
    return rows.withColumn("anomaly", (F.col("number_events") >= 8).cast("int"))


SCORED = "scored as (select *, events_per_second as scores, cast(number_events >= 8 as int) as anomaly from feat)"
FIRST = """firsts as (select * exclude (place) from (
  select *, row_number() over (partition by entity order by scores desc, bin) as place from scored) t where place = 1)"""
TOP = "top_e as (select entity from firsts order by scores desc, entity limit 50)"


@register(S.query("select * from scored", *FEAT, SCORED))
def sorted_scores(spark, sf_dir):
    return rank.sort_by_score(scored(spark, sf_dir))


@register(S.query("select * from scored where anomaly = 1", *FEAT, SCORED))
def flagged_rows(spark, sf_dir):
    return rank.flagged(scored(spark, sf_dir))


@register(S.query("select * from scored where scores >= (select quantile_cont(scores, 0.9999) from scored)", *FEAT, SCORED))
def rows_above_percentile(spark, sf_dir):
    return rank.above_percentile(scored(spark, sf_dir))


@register(S.query("select * from firsts", *FEAT, SCORED, FIRST))
def rank_first(spark, sf_dir):
    return rank.rank_first(scored(spark, sf_dir))


@register(S.query("select entity, round(avg(scores), 9) as mean_score from scored group by entity", *FEAT, SCORED))
def rank_mean(spark, sf_dir):
    return rounded(rank.rank_mean(scored(spark, sf_dir)), "mean_score")


@register(S.query("select entity, round(var_samp(Hosts_per_User), 9) as variance from feat group by entity", *FEAT))
def hosts_variance(spark, sf_dir):
    return rounded(rank.feature_variance(feature_table(spark, sf_dir)), "variance")


@register(
    S.query(
        """select entity, bin, round(weighted, 9) as scores from (
             select entity, bin, weighted, row_number() over (partition by entity order by weighted desc nulls last, bin) as place from (
               select entity, bin, (scores - min(scores) over ()) / (max(scores) over () - min(scores) over ())
                      * var_samp(Hosts_per_User) over (partition by entity) as weighted from scored) a) b where place = 1""",
        *FEAT,
        SCORED,
    )
)
def rank_variance(spark, sf_dir):
    return rounded(rank.rank_variance(scored(spark, sf_dir)).select("entity", "bin", "scores"), "scores")


@register(
    S.query("select entity, scores, row_number() over (order by scores desc, entity) as position from firsts", *FEAT, SCORED, FIRST)
)
def ranking_positions(spark, sf_dir):
    firsts = rank.worst_row_per_entity(scored(spark, sf_dir)).select("entity", "scores")
    return rank.with_position(firsts, F.desc("scores"), F.asc("entity"))


@register(
    S.query(
        """select entity, account_n as n from (select account as entity, count(*) as account_n from kept group by account) t
           order by account_n desc, entity limit 50""",
        *S.BASE[:2],
    )
)
def busiest_entities(spark, sf_dir):
    counts = kept(spark, sf_dir).groupBy(F.col("account").alias("entity")).agg(F.count("*").alias("n"))
    top = profile.top_entities(counts, 50, "n")
    return counts.join(F.broadcast(top), "entity")


@register(S.query("select feat.* from feat semi join top_e using (entity)", *FEAT, SCORED, FIRST, TOP))
def rows_of_top_entities(spark, sf_dir):
    firsts = rank.worst_row_per_entity(scored(spark, sf_dir))
    return profile.rows_of(feature_table(spark, sf_dir), profile.top_entities(firsts))


@register(S.query("select feat.* from feat anti join (select entity, bin from scored where anomaly = 1) f using (entity, bin)", *FEAT, SCORED))
def rows_not_flagged(spark, sf_dir):
    return profile.rows_not_in(feature_table(spark, sf_dir), rank.flagged(scored(spark, sf_dir)))


HASH = "cast('0x' || substr(md5(concat_ws('|', {}, '123')), 1, 8) as bigint)"
SAMPLED = f"""sampled as (select * exclude (place) from (select feat.*, row_number() over (partition by entity
  order by {HASH.format("entity, cast(bin as varchar)")}, entity, bin) as place from feat) t where place <= %d)"""


@register(S.query("select * from sampled", *FEAT, SAMPLED % 12))
def sampled_rows_per_entity(spark, sf_dir):
    return sampling.rows_per_entity(feature_table(spark, sf_dir), 12)


for label, sign in (("training_rows", "<"), ("test_rows", ">=")):

    @register(S.query(f"select * from feat where {HASH.format('entity')} {sign} {int(0.7 * 2**32)}", *FEAT), label)
    def _split(spark, sf_dir, part=0 if sign == "<" else 1):
        return sampling.split_rows(feature_table(spark, sf_dir), ["entity"])[part]


@register(
    S.query(
        """select p.* exclude (weekday), false as is_outsider from (select * from sampled semi join top_e using (entity)) p
             anti join (select entity, bin from scored where anomaly = 1) f using (entity, bin)
           union all select feat.* exclude (weekday), true from feat semi join top_e using (entity)
             semi join (select entity, bin from scored where anomaly = 1) f using (entity, bin)""",
        *FEAT,
        SCORED,
        FIRST,
        TOP,
        SAMPLED % 10,
    )
)
def anomaly_profile(spark, sf_dir):
    """Normal and flagged rows of the top entities; the weekday is left out."""
    rows = scored(spark, sf_dir)
    top = profile.top_entities(rank.worst_row_per_entity(rows))
    features = rows.drop("scores", "anomaly")
    return profile.anomaly_profile(features, rank.flagged(rows), top, 10, leave_out=["weekday"])


# --- scenarios -----------------------------------------------------------------------------------

LISTED = "listed as (select account from kept group by account order by count(*) desc, account limit 30)"
SHIFTED = f"""{LISTED}, kept2 as (select event_code, host, case when kept.account in (select account from listed) and ts >= lo + interval 14 day
    then ts + interval 1 hour else ts end as ts, logon_id, account, source, source_port, logon_type from kept, span),
  clean2 as (select distinct event_code, host, ts, account, source, source_port, logon_type from kept2 where not {S.IGNORED})"""


def listed(events: DataFrame) -> DataFrame:
    """The thirty busiest accounts."""
    counts = events.groupBy("account").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "account").limit(30).select("account")


def shifted(spark, sf_dir):
    events = kept(spark, sf_dir)
    return prep.shift_activity(events, listed(events), dates(spark, sf_dir)[0] + _days(14), 1)


@register(S.query("select account, sum(epoch_us(ts) // 1000000)::bigint as seconds, count(*) as n from kept2 group by account", *S.BASE, SHIFTED))
def scenario_clock_change(spark, sf_dir):
    seconds = F.floor(F.unix_micros("ts") / 1_000_000)
    return shifted(spark, sf_dir).groupBy("account").agg(F.sum(seconds).alias("seconds"), F.count("*").alias("n"))


for label, keep, condition in (("scenario_absence", False, "in"), ("scenario_one_site_left", True, "not in")):

    @register(
        S.query(
            f"""select account, count(*) as n from kept, span where not (account {condition} (select account from listed)
                and ts >= lo + interval 7 day and ts < lo + interval 21 day) group by account""",
            *S.BASE,
            LISTED,
        ),
        label,
    )
    def _absence(spark, sf_dir, keep=keep):
        events, first = kept(spark, sf_dir), dates(spark, sf_dir)[0]
        left = prep.remove_activity(events, listed(events), first + _days(7), first + _days(21), keep)
        return left.groupBy("account").agg(F.count("*").alias("n"))


RANKED = """{0} as (select entity, score, row_number() over (order by score desc, entity) as place
  from (select entity, max(events_per_second) as score from {1} group by entity) t)"""


@register(
    S.query(
        """select a.entity, a.place - b.place as position_shift, round(abs(a.score) - abs(b.score), 9) as score_shift
           from ranked2 a join ranked b using (entity)""",
        *FEAT,
        SHIFTED,
        S.features(source="clean2", name="feat2"),
        RANKED.format("ranked", "feat"),
        RANKED.format("ranked2", "feat2"),
    )
)
def rank_shift_after_clock_change(spark, sf_dir):
    days = dates(spark, sf_dir)
    runs = [prep.clean(e) for e in (shifted(spark, sf_dir), kept(spark, sf_dir))]
    tables = [extract_features(e, *days).withColumn("scores", F.col("events_per_second")) for e in runs]
    return rounded(rank.rank_shift(*[rank.worst_row_per_entity(t) for t in tables]), "score_shift")


# --- detectors -----------------------------------------------------------------------------------

VECS = "points as (select vec_id, embedding::double[] as v from embeddings)"
DIM = "range(1, 65)"


def over_dims(expression: str) -> str:
    """Sum of an expression of x and y over the coordinates of two vectors."""
    return f"list_sum(list_transform(list_zip(a.v, b.v), lambda p: {expression}))"


EUCLID = f"sqrt({over_dims('(p[1] - p[2]) ** 2')})"
SPREAD_SQL = """spread as (select list(s order by i) as s from (select i, stddev_samp(v[i]) as s from points, range(1, 65) r(i) group by i) t)"""
UNIT = "points as (select vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as v from {})"
RAW = "raw as (select vec_id, embedding::double[] as e from embeddings)"
CENTRED = "centred as (select vec_id, list_transform(e, lambda x: x - list_sum(e) / len(e)) as e from raw)"
SCALED = "points as (select vec_id, list_transform(list_zip(e, s), lambda p: p[1] / p[2]) as v from raw, spread)"
SPREAD_RAW = "spread as (select list(s order by i) as s from (select i, stddev_samp(e[i]) as s from raw, range(1, 65) r(i) group by i) t)"

EMBEDDING_METRICS = {
    "euclidean": (EUCLID, [VECS]),
    "sqeuclidean": (over_dims("(p[1] - p[2]) ** 2"), [VECS]),
    "manhattan": (over_dims("abs(p[1] - p[2])"), [VECS]),
    "chebyshev": ("list_max(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2])))", [VECS]),
    "canberra": (over_dims("case when p[1] = p[2] then 0 else abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) end"), [VECS]),
    "braycurtis": (f"{over_dims('abs(p[1] - p[2])')} / {over_dims('abs(p[1] + p[2])')}", [VECS]),
    "cosine": (f"greatest(0.0, 1 - {over_dims('p[1] * p[2]')})", [RAW, UNIT.format("raw")]),
    "correlation": (f"greatest(0.0, 1 - {over_dims('p[1] * p[2]')})", [RAW, CENTRED, UNIT.format("centred")]),
    "seuclidean": (EUCLID, [RAW, SPREAD_RAW, SCALED]),
}


def embedding_knn(spark, sf_dir, **params):
    rows = table(spark, sf_dir, "embeddings")
    detector = KNNDetector(vectorCol="embedding", keyCols=["vec_id"], **params)
    return rounded(detector.fit_transform(rows).select("vec_id", "scores"), "scores", digits=6)


for metric, (pair, ctes) in EMBEDDING_METRICS.items():

    @register(S.query(S.nearest("points", "vec_id", pair, 20, True), *ctes), f"knn_{metric}_embeddings")
    def _metric(spark, sf_dir, metric=metric):
        return embedding_knn(spark, sf_dir, metric=metric)


for method in ("largest", "median"):

    @register(S.query(S.nearest("points", "vec_id", EUCLID, 10, False, method), VECS), f"knn_{method}_distance")
    def _method(spark, sf_dir, method=method):
        return embedding_knn(spark, sf_dir, method=method, n_neighbors=10, include_self=False)


@register(
    S.query(
        f"""select vec_id, neighbour, round(d, 6) as distance, cast(place as int) as place from (
              select a.vec_id, b.vec_id as neighbour, {EUCLID} as d,
                     row_number() over (partition by a.vec_id order by {EUCLID}, b.vec_id) as place
              from points a join points b on a.vec_id <> b.vec_id) t where place <= 10""",
        VECS,
    )
)
def nearest_embeddings(spark, sf_dir):
    pairs = knn_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)
    return rounded(pairs, "distance", digits=6)


@register()
def approximate_neighbours_embeddings(spark, sf_dir):
    """Ten nearest rows by hash tables, the row itself among them."""
    refs = materialise(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref_id"), F.col("embedding").cast("array<double>").alias("vector"), F.lit(1).cast("long").alias("copies")))
    near = approximate_knn_search(refs.select(F.col("ref_id").alias("query_id"), "vector"), refs, 10)
    found = near.select(F.col("query_id").alias("vec_id"), F.posexplode("near").alias("place", "c"))
    return rounded(found.select("vec_id", F.col("c.ref_id").alias("neighbour"), "c.distance", (F.col("place") + 1).alias("place")), "distance", digits=6)


POINTS = "points as (select entity || '/' || bin as id, " + ", ".join(["weekday", *S.NUMERIC]) + " from norm)"
MODEL_COLUMNS = ["weekday", *S.NUMERIC]
FLAT = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) ** 2" for c in MODEL_COLUMNS) + ")"


def keyed_features(spark, sf_dir):
    return normalise.normalise(materialise(feature_table(spark, sf_dir))).withColumn(
        "id", F.concat_ws("/", "entity", F.col("bin").cast("string"))
    )


@register(S.query(S.nearest("points", "id", FLAT, 20, True), *FEAT, S.NORMALISED, POINTS))
def knn_features_user_day(spark, sf_dir):
    """The default detector on whole normalised features."""
    rows = keyed_features(spark, sf_dir)
    return rounded(KNNDetector(featureCols=MODEL_COLUMNS).fit_transform(rows).select("id", "scores"), "scores", digits=6)


@register()
def approximate_knn_features_user_day(spark, sf_dir):
    """The default detector, with hash tables in place of the exact search."""
    rows = keyed_features(spark, sf_dir)
    found = KNNDetector(featureCols=MODEL_COLUMNS, approximate_above=1000).fit_transform(rows)
    return rounded(found.select("id", "scores"), "scores", digits=6)


@register(
    S.query(
        f"""select id from ({S.nearest("points", "id", FLAT, 20, True)}) s where scores >
            (select quantile_cont(scores, 0.99) from ({S.nearest("points", "id", FLAT, 20, False)}) t)""",
        *FEAT,
        S.NORMALISED,
        POINTS,
    )
)
def knn_flagged_rows(spark, sf_dir):
    """Rows above the 99th percentile of the scores that leave the row itself out."""
    detector = KNNDetector(featureCols=MODEL_COLUMNS, contamination=0.01)
    return rank.flagged(detector.fit_transform(keyed_features(spark, sf_dir))).select("id")


BITS = ["proportion_2", "proportion_3", "proportion_9", "proportion_10", "proportion_11_12", "events_per_second"]
BIT_POINTS = "points as (select entity || '/' || bin as id, " + ", ".join(f"cast({c} <> 0 as int) as {c}" for c in BITS) + " from norm)"
TT = "(" + " + ".join(f"a.{c} * b.{c}" for c in BITS) + ")::double"
TF = "(" + " + ".join(f"a.{c} * (1 - b.{c})" for c in BITS) + ")::double"
FT = "(" + " + ".join(f"(1 - a.{c}) * b.{c}" for c in BITS) + ")::double"
FF = "(" + " + ".join(f"(1 - a.{c}) * (1 - b.{c})" for c in BITS) + ")::double"
N = float(len(BITS))


def share(top: str, bottom: str) -> str:
    return f"case when {bottom} > 0 then {top} / {bottom} else 0.0::double end"


BIT_METRICS = {
    "matching": f"({TF} + {FT}) / {N}",
    "dice": share(f"({TF} + {FT})", f"(2 * {TT} + {TF} + {FT})"),
    "jaccard": share(f"({TF} + {FT})", f"({TT} + {TF} + {FT})"),
    "kulsinski": f"({TF} + {FT} - {TT} + {N}) / ({TF} + {FT} + {N})",
    "rogerstanimoto": f"2 * ({TF} + {FT}) / ({TT} + {FF} + 2 * ({TF} + {FT}))",
    "russellrao": f"({N} - {TT}) / {N}",
    "sokalsneath": share(f"2 * ({TF} + {FT})", f"({TT} + 2 * ({TF} + {FT}))"),
    "yule": share(f"2 * {TF} * {FT}", f"({TT} * {FF} + {TF} * {FT})"),
}
HAMMING = "(" + " + ".join(f"cast(a.{c} <> b.{c} as int)" for c in BITS) + f")::double / {N}"
HAMMING_POINTS = "points as (select entity || '/' || bin as id, " + ", ".join(BITS) + " from norm)"

for metric, pair in {**BIT_METRICS, "hamming": HAMMING}.items():

    @register(
        S.query(S.nearest("points", "id", pair, 40, True), *FEAT, S.NORMALISED, HAMMING_POINTS if metric == "hamming" else BIT_POINTS),
        f"knn_{metric}_features",
    )
    def _bit_metric(spark, sf_dir, metric=metric):
        detector = KNNDetector(featureCols=BITS, metric=metric, n_neighbors=40)
        return rounded(detector.fit_transform(keyed_features(spark, sf_dir)).select("id", "scores"), "scores", digits=6)


PAIR_OF = ["number_events", "Hosts_per_User"]
MAHALANOBIS = """sqrt(greatest(0.0, (vy * (a.x - b.x) ** 2 - 2 * cxy * (a.x - b.x) * (a.y - b.y) + vx * (a.y - b.y) ** 2)
  / (vx * vy - cxy * cxy)))"""


@register(
    S.query(
        S.nearest("points", "id", MAHALANOBIS, 40, True).replace("points b", "points b, spread"),
        *FEAT,
        S.NORMALISED,
        "points as (select entity || '/' || bin as id, number_events as x, Hosts_per_User as y from norm)",
        "spread as (select var_samp(x) as vx, var_samp(y) as vy, covar_samp(x, y) as cxy from points)",
    )
)
def knn_mahalanobis_features(spark, sf_dir):
    detector = KNNDetector(featureCols=PAIR_OF, metric="mahalanobis", n_neighbors=40)
    return rounded(detector.fit_transform(keyed_features(spark, sf_dir)).select("id", "scores"), "scores", digits=6)


def grouped_features(spark, sf_dir) -> DataFrame:
    features = materialise(feature_table(spark, sf_dir))
    return group_features(features, Options())[0]


@register()
def isolation_forest_user_day(spark, sf_dir):
    return IsolationForestDetector().fit_transform(grouped_features(spark, sf_dir))


@register()
def mixture_energy_user_day(spark, sf_dir):
    return MixtureEnergyDetector().fit_transform(grouped_features(spark, sf_dir))


@register()
def local_ensemble_embeddings(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return LSCPDetector(vectorCol="embedding", keyCols=["vec_id"]).fit_transform(rows).select("vec_id", "scores", "anomaly")


ENERGY = """-ln(sum(weight * exp(-0.5 * ((x - mx) ** 2 * sy - 2 * (x - mx) * (y - my) * c + (y - my) ** 2 * sx) / (sx * sy - c * c))
   / (2 * pi() * sqrt(sx * sy - c * c))))"""


@register(
    S.query(
        f"""select entity, bin, round({ENERGY}, 6) as energy from (select entity, bin, number_events::double as x, Hosts_per_User::double as y from feat) p
            cross join components group by entity, bin""",
        *FEAT,
        """components as (select weekday, count(*)::double / (select count(*) from feat) as weight, avg(number_events) as mx, avg(Hosts_per_User) as my,
           var_pop(number_events) + 1e-6 as sx, var_pop(Hosts_per_User) + 1e-6 as sy, covar_pop(number_events, Hosts_per_User) as c
           from feat group by weekday)""",
    )
)
def energy_of_weekday_mixture(spark, sf_dir):
    """Energy under a given mixture: one component per weekday."""
    x, y = F.col("number_events").cast("double"), F.col("Hosts_per_User").cast("double")
    features = feature_table(spark, sf_dir).select("entity", "bin", "weekday", x.alias("x"), y.alias("y"))
    parts = features.groupBy("weekday").agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.var_pop("x").alias("sx"), F.var_pop("y").alias("sy"), F.covar_pop("x", "y").alias("c"),
    ).collect()
    total = sum(p["n"] for p in parts)
    energy = add_energy(
        features,
        ["x", "y"],
        [p["n"] / total for p in parts],
        [[p["mx"], p["my"]] for p in parts],
        [[[p["sx"], p["c"]], [p["c"], p["sy"]]] for p in parts],
    )
    return rounded(energy.select("entity", "bin", "energy"), "energy", digits=6)


STEP = """
start as (select weekday, count(*)::double / (select count(*) from feat) as weight, avg(number_events) as mx, avg(Hosts_per_User) as my,
  var_pop(number_events) + 0.001 as sx, var_pop(Hosts_per_User) + 0.001 as sy, covar_pop(number_events, Hosts_per_User) as c from feat group by weekday),
logs as (select entity, bin, weekday, x, y, ln(weight) - ln(2 * pi()) - 0.5 * ln(sx * sy - c * c)
    - 0.5 * ((x - mx) ** 2 * sy - 2 * (x - mx) * (y - my) * c + (y - my) ** 2 * sx) / (sx * sy - c * c) as l
  from start cross join (select entity, bin, number_events::double as x, Hosts_per_User::double as y from feat)),
tops as (select *, exp(l - max(l) over (partition by entity, bin)) as e from logs),
shares as (select weekday, x, y, e / sum(e) over (partition by entity, bin) as r from tops),
sums as (select weekday, sum(r) as n, sum(r * x) / sum(r) as mx, sum(r * y) / sum(r) as my from shares group by weekday)"""


@register(
    S.query(
        """select s.weekday, round(any_value(s.n) / (select count(*) from feat), 6) as weight, round(any_value(s.mx), 6) as mean_x, round(any_value(s.my), 6) as mean_y,
             round(sum(r * (x - s.mx) ** 2) / any_value(s.n) + 0.002 * (select count(*) from feat) / any_value(s.n), 6) as var_x,
             round(sum(r * (y - s.my) ** 2) / any_value(s.n) + 0.002 * (select count(*) from feat) / any_value(s.n), 6) as var_y,
             round(sum(r * (x - s.mx) * (y - s.my)) / any_value(s.n), 6) as covar
           from shares join sums s on s.weekday = shares.weekday group by s.weekday""",
        *FEAT,
        STEP,
    )
)
def mixture_step_of_weekdays(spark, sf_dir):
    """One penalised EM step from a mixture with one component per weekday."""
    x, y = F.col("number_events").cast("double"), F.col("Hosts_per_User").cast("double")
    features = feature_table(spark, sf_dir).select("weekday", x.alias("x"), y.alias("y"), F.array(x, y).alias("z"))
    parts = features.groupBy("weekday").agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.var_pop("x").alias("sx"), F.var_pop("y").alias("sy"), F.covar_pop("x", "y").alias("c"),
    ).orderBy("weekday").collect()
    total = sum(p["n"] for p in parts)
    start = Mixture(
        [p["n"] / total for p in parts],
        [[p["mx"], p["my"]] for p in parts],
        [[[p["sx"] + 0.001, p["c"]], [p["c"], p["sy"] + 0.001]] for p in parts],
    )
    after, _ = em_step(features, "z", start, penalty=0.001)
    rows = [(p["weekday"], w, *m, s[0][0], s[1][1], s[0][1]) for p, w, m, s in zip(parts, after.weights, after.means, after.covariances)]
    names = ["weight", "mean_x", "mean_y", "var_x", "var_y", "covar"]
    return rounded(spark.createDataFrame(rows, "weekday int, " + ", ".join(f"{c} double" for c in names)), *names, digits=6)


@register(
    S.query(
        f"""select entity, bin, {", ".join(f"(sum(cast({c} as decimal(26,9))) over w)::double / count({c}) over w as {c}" for c in S.NUMERIC)}
            from feat window w as (partition by entity order by bin rows unbounded preceding)""",
        *FEAT,
    )
)
def running_entity_means(spark, sf_dir):
    return normalise.running_means(feature_table(spark, sf_dir))


@register(
    S.query(
        """select vec_id, cast(case when coalesce(cb, -2) > coalesce(ca, -2) then 1 else 0 end as int) as best from (
             select p.vec_id, case when isnan(corr(a, greatest(a, b))) then -2 else corr(a, greatest(a, b)) end as ca,
                    case when isnan(corr(b, greatest(a, b))) then -2 else corr(b, greatest(a, b)) end as cb
             from near p join given g on g.vec_id = p.neighbour group by p.vec_id) t""",
        VECS,
        f"""near as (select vec_id, neighbour from (select a.vec_id, b.vec_id as neighbour,
              row_number() over (partition by a.vec_id order by {EUCLID}, b.vec_id) as place
              from points a join points b on a.vec_id <> b.vec_id) t where place <= 30)""",
        "given as (select vec_id, v[1] as a, v[2] as b from points)",
    )
)
def locally_best_detector(spark, sf_dir):
    """Two coordinates stand in for two detectors' scores."""
    rows = table(spark, sf_dir, "embeddings")
    coordinate = [F.get("embedding", F.lit(i)).cast("double") for i in (0, 1)]
    given = rows.select(F.col("vec_id").alias("neighbour"), coordinate[0].alias("a"), coordinate[1].alias("b"))
    given = given.withColumn("target", F.greatest("a", "b"))
    pairs = knn_pairs(rows, "vec_id", "embedding", 30)
    return pick_locally(pairs.join(given, "neighbour"), "vec_id", ["a", "b"], "target")


# --- random forest -------------------------------------------------------------------------------

FEW_TREES = {"num_trees": 50, "max_depth": 5}


@register()
def group_drift_visits(spark, sf_dir):
    return group_drift(kept(spark, sf_dir), Options(method="RF", span="full", params=FEW_TREES))


@register()
def group_drift_changes(spark, sf_dir):
    return group_drift(kept(spark, sf_dir), Options(method="RF", span="full", params=FEW_TREES, group_changes=True))


@register()
def forest_grid_accuracy(spark, sf_dir):
    features = materialise(feature_table(spark, sf_dir))
    model = grouping.fit_groups(normalise.entity_means(features))
    tried = forest.grid_search(grouping.labelled_means(features, model), num_trees=20)
    return spark.createDataFrame(tried, "mtry int, min_node_size int, sample_fraction double, max_depth int, accuracy double")


@register()
def forest_out_of_bag_error(spark, sf_dir):
    """Share of entities whose group is not that of the trees that did not see them; all parameters at their defaults."""
    features = materialise(feature_table(spark, sf_dir))
    model = grouping.fit_groups(normalise.entity_means(features))
    return forest.out_of_bag_error(forest.group_votes(grouping.labelled_means(features, model)))


# --- whole analyses, stored models, streams ------------------------------------------------------


@register()
def ranking_from_events(spark, sf_dir):
    """From raw events to a ranking with the default method."""
    return find_anomalies(kept(spark, sf_dir), Options(rank="first"))


@register()
def flagged_from_events(spark, sf_dir):
    return find_anomalies(kept(spark, sf_dir), Options(method="IF", params={"contamination": 0.01}))


@register()
def ranking_with_stored_models(spark, sf_dir):
    """Models fitted on the first half of the range score the second."""
    first, last = dates(spark, sf_dir)
    middle, path = first + _days((last - first).days // 2), new_shared_path(spark, "models")
    common = {"method": "IF", "rank": "first"}
    find_anomalies(kept(spark, sf_dir), Options(start=first, end=middle, **common), save_to=path)
    return find_anomalies(kept(spark, sf_dir), Options(start=middle, end=last, **common), load_from=path)


def write_quarters(spark, sf_dir, path) -> int:
    """Logons as files that arrive in time order, a quarter of the range after the other; the number of files a quarter."""
    events = logons(spark, sf_dir)
    first, last = dates(spark, sf_dir)
    days, files = (last - first).days, max(1, events.count() // 5_000_000)
    for quarter in range(4):
        a, b = (first + _days(days * q // 4) for q in (quarter, quarter + 1))
        prep.in_range(events, a, b).repartition(files).write.mode("append").parquet(path)
    return files


def run_stream(spark, sf_dir, transform=None, ended=False):
    """What the stream of all logons has handed out; with ``ended`` it goes on after a restart, and finds the end mark."""
    path, out, state = (new_shared_path(spark, f"stream-{part}") for part in ("in", "out", "state"))
    cleaned_logons = clean_stream(stream_logons(spark, path, write_quarters(spark, sf_dir, path)))
    features = stream_features(cleaned_logons, *dates(spark, sf_dir))
    write_stream(features, out, state, transform).awaitTermination()
    if ended:
        end_stream(spark, path)
        write_stream(features, out, state, transform).awaitTermination()
    return read_stream_output(spark, out)


@register(
    S.query(
        "select feat.* from feat, span where epoch_us(lo) + (bin + 1) * 86400000000 <= (select epoch_us(max(ts)) - 3600000000 from kept)",
        *FEAT,
    )
)
def stream_features_closed_bins(spark, sf_dir):
    return run_stream(spark, sf_dir)


@register(S.query("select * from feat", *FEAT))
def stream_features_finished(spark, sf_dir):
    """The end mark closes the last bins, so the stream hands out the whole table."""
    return run_stream(spark, sf_dir, ended=True)


@register()
def stream_scores(spark, sf_dir):
    """Closed bins scored with models fitted on the first half of the range."""
    first, last = dates(spark, sf_dir)
    middle, path = first + _days((last - first).days // 2), new_shared_path(spark, "models")
    find_anomalies(kept(spark, sf_dir), Options(start=first, end=middle, method="IF"), save_to=path)
    models = Models.load(path, "IF")
    return run_stream(spark, sf_dir, scorer(models.groups, models.bounds, models.detector, new_shared_path(spark, "running")))
