"""Hand-computed edge cases of cleaning, bins, features and rankings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loginlens.functions.scaling import box_cox, one_hot
from loginlens.functions.timebin import TimeBin, clock_to_seconds, days_since_1900, seconds_to_clock
from loginlens.operators import calendar, prep, rank
from loginlens.operators.features import Feature, FeatureRegistry, extract_features
from loginlens.operators.forest import changed_groups
from loginlens.operators.grouping import visited_groups
from loginlens.operators.normalise import merge_min_max, normalise
from loginlens.schema import model_columns


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def day(make_logons, *rows, **how):
    return extract_features(make_logons(list(rows)), "2021-06-01", "2021-06-02", **how)


def test_single_event_has_rate_zero(make_logons):
    assert only(day(make_logons, {"ts": "2021-06-01 08:00:00"}))["events_per_second"] == 0.0


def test_events_of_one_instant_have_rate_one(make_logons):
    rows = [{"ts": "2021-06-01 08:00:00", "host": h} for h in ("A", "B", "C")]
    assert only(day(make_logons, *rows))["events_per_second"] == 1.0


def test_rate_is_events_over_elapsed_seconds(make_logons):
    rows = [{"ts": f"2021-06-01 08:00:0{s}"} for s in (0, 2, 5, 8)]
    assert only(day(make_logons, *rows))["events_per_second"] == 0.5


def test_type_shares_count_unknown_types_in_the_denominator(make_logons):
    rows = [{"ts": f"2021-06-01 08:00:0{i}", "type": t} for i, t in enumerate((2, 2, 11, 12))]
    row = only(day(make_logons, *rows))
    assert (row["proportion_2"], row["proportion_11_12"], row["proportion_3"]) == (0.5, 0.5, 0.0)
    rows.append({"ts": "2021-06-01 09:00:00", "type": None})
    assert only(day(make_logons, *rows))["proportion_2"] == 0.4


def test_null_is_one_distinct_value(make_logons):
    rows = [{"ts": f"2021-06-01 08:00:0{i}", "source": s} for i, s in enumerate(("A", "B", None, None))]
    assert only(day(make_logons, *rows))["Sources_per_User"] == 3


def test_deduplication_ignores_the_logon_id_and_keeps_nulls_equal(make_logons):
    same = {"ts": "2021-06-01 08:00:00", "source": None, "port": None}
    assert prep.deduplicate(make_logons([{**same, "logon_id": 1}, {**same, "logon_id": 2}])).count() == 1


def test_ignored_accounts_compare_as_text(make_logons):
    accounts = ["0", "10000", "10001", "0010", "admin", None, "-1", "99999999999999999999"]
    rows = make_logons([{"ts": "2021-06-01 08:00:00", "account": a} for a in accounts])
    left = {r["account"] for r in prep.drop_ignored_accounts(rows).collect()}
    assert left == {"10001", "0010", "admin", None, "-1", "99999999999999999999"}


def test_last_bin_may_reach_past_the_end(make_logons):
    five = TimeBin("h", 5)
    assert five.count("2021-06-01", "2021-06-02") == 5
    rows = make_logons([{"ts": "2021-06-01 23:59:59"}, {"ts": "2021-06-02 00:59:59"}, {"ts": "2021-06-02 01:00:00"}])
    row = only(extract_features(rows, "2021-06-01", "2021-06-02", time_bin=five))
    assert (row["bin"], row["number_events"], row["hour"]) == (4, 2, 20 * 3600)
    clipped = only(extract_features(rows, "2021-06-01", "2021-06-02", time_bin=five, clip_end=True))
    assert clipped["number_events"] == 1


def test_equal_dates_give_one_bin():
    assert TimeBin().count("2021-06-01", "2021-06-01") == 1


@pytest.mark.parametrize("hours", [0, 73])
def test_bin_width_is_limited(hours):
    with pytest.raises(ValueError):
        TimeBin("h", hours)


def test_weekday_starts_on_monday(make_logons):
    rows = make_logons([{"ts": "2021-06-01 01:00:00"}, {"ts": "2021-06-06 01:00:00"}])
    found = extract_features(rows, "2021-06-01", "2021-06-08").orderBy("bin").collect()
    assert [r["weekday"] for r in found] == [2, 7]


def test_day_and_hour_of_multi_day_bins(make_logons):
    rows = make_logons([{"ts": "2021-06-03 02:00:00"}])
    row = only(extract_features(rows, "2021-06-01", "2021-06-05", time_bin=TimeBin("dh", 30)))
    assert (row["bin"], row["day"], row["hour"]) == (1, dt.date(2021, 6, 2), 6 * 3600)


def test_empty_entity_is_left_out(make_logons):
    rows = make_logons([{"ts": "2021-06-01 01:00:00", "account": None}, {"ts": "2021-06-01 01:00:00"}])
    assert extract_features(rows, "2021-06-01", "2021-06-02").count() == 1


def test_user_defined_features(make_logons):
    registry = FeatureRegistry().add(Feature("ports", F.count_distinct("source_port"), normalise=False, in_means=False))
    row = only(day(make_logons, {"ts": "2021-06-01 01:00:00", "port": 1}, {"ts": "2021-06-01 02:00:00", "port": 2}, registry=registry))
    assert row["ports"] == 2
    assert registry.left_out_of("in_means") == ["ports"]
    with pytest.raises(ValueError):
        registry.add(Feature("ports", F.count("*")))


def test_constant_feature_is_normalised_to_a_half(spark):
    rows = spark.createDataFrame([("a", 0, 1, 5), ("b", 0, 1, 7)], "entity string, bin long, x int, y int")
    found = normalise(rows).orderBy("entity").collect()
    assert [(r["x"], r["y"]) for r in found] == [(0.5, 0.0), (0.5, 1.0)]


def test_bounds_widen_feature_by_feature():
    assert merge_min_max({"x": (0, 2), "y": (5, 6)}, {"x": (1, 3), "y": (4, 5)}) == {"x": (0, 3), "y": (4, 6)}
    with pytest.raises(ValueError):
        merge_min_max({"x": (0, 1)}, {"y": (0, 1)})


def test_group_visits_and_changes(spark):
    rows = spark.createDataFrame([("a", b, g) for b, g in enumerate((1, 1, 2, 1))] + [("b", 0, 3)], "entity string, bin long, group_id int")
    assert {r["entity"]: r["visited_groups"] for r in visited_groups(rows).collect()} == {"a": 2, "b": 1}
    assert {r["entity"]: r["changed_groups"] for r in changed_groups(rows).collect()} == {"a": 2, "b": 0}


def test_variance_ranking_puts_single_rows_last(spark):
    rows = [("a", 0, 9.0, 1), ("b", 0, 1.0, 1), ("b", 1, 2.0, 5), ("c", 0, 3.0, 1), ("c", 1, 3.0, 2)]
    scored = spark.createDataFrame(rows, "entity string, bin long, scores double, Hosts_per_User long")
    found = rank.rank_variance(scored).collect()
    assert [r["entity"] for r in found] == ["b", "c", "a"]
    assert found[-1]["scores"] is None


def test_variance_ranking_turns_scores_where_low_is_bad(spark):
    rows = [("a", 0, -1.0, 1), ("a", 1, 1.0, 5), ("b", 0, 1.0, 1), ("b", 1, 1.0, 5)]
    scored = spark.createDataFrame(rows, "entity string, bin long, scores double, Hosts_per_User long")
    found = rank.rank_variance(scored, higher_is_worse=False).collect()
    assert [(r["entity"], r["scores"]) for r in found] == [("a", 8.0), ("b", 0.0)]


def test_rankings_follow_the_direction_of_the_score(spark):
    scored = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 2.0)], "entity string, bin long, scores double")
    assert [(r["entity"], r["bin"]) for r in rank.rank_first(scored).collect()] == [("a", 1), ("b", 0)]
    assert [(r["entity"], r["bin"]) for r in rank.rank_first(scored, False).collect()] == [("a", 0), ("b", 0)]
    assert [r["mean_score"] for r in rank.rank_mean(scored).collect()] == [2.0, 2.0]
    with pytest.raises(ValueError):
        rank.rank(scored, "x")


def test_positions_are_gapless_over_partitions(spark):
    numbers = spark.range(1000).repartition(7)
    found = rank.with_position(numbers, F.desc("id")).collect()
    assert {r["id"]: r["position"] for r in found} == {i: 1000 - i for i in range(1000)}


def test_month_without_events_is_zero(make_logons):
    rows = [{"ts": f"2021-01-0{i} 00:00:00"} for i in range(1, 6)] + [{"ts": f"2021-03-0{i} 00:00:00"} for i in range(1, 8)]
    found = calendar.monthly_timeline(make_logons(rows)).orderBy("period").collect()
    assert [r["count"] for r in found] == [5, 0, 7]


def test_busy_range_and_its_fallbacks(make_logons):
    months = [{"ts": f"2021-{m:02d}-{d:02d} 00:00:00"} for m in range(1, 13) for d in range(1, 3 if m not in (5, 6) else 20 + m)]
    # Ten months of 2 events, then 24 and 25: the quantile at 0.90228 * 11 = 9.925 is 2 + 0.925 * 22 = 22.35 events.
    assert calendar.resolve_range(make_logons(months)) == (dt.date(2021, 5, 1), dt.date(2021, 7, 1))
    even = make_logons([{"ts": f"2021-{m:02d}-03 00:00:00"} for m in range(1, 13)])
    assert calendar.resolve_range(even) == (dt.date(2021, 1, 3), dt.date(2021, 12, 4))
    one = make_logons([{"ts": "2021-06-03 00:00:00"}])
    assert calendar.resolve_range(one) == (dt.date(2021, 6, 3), dt.date(2021, 6, 4))
    assert calendar.resolve_range(one, start="2021-01-01", end="2021-02-01") == (dt.date(2021, 1, 1), dt.date(2021, 2, 1))
    with pytest.raises(ValueError):
        calendar.resolve_range(one, start="2021-02-01", end="2021-01-01")


def test_time_values(spark):
    row = spark.sql("select date'2021-06-01' as d, '20:15:30' as c, 72930 as s").select(
        days_since_1900(F.col("d")).alias("n"), clock_to_seconds(F.col("c")).alias("s"), seconds_to_clock(F.col("s")).alias("c")
    ).first()
    assert (row["n"], row["s"], row["c"]) == (44346, 72930, "20:15:30")


def test_box_cox_of_non_positive_values_is_the_limit(spark):
    row = spark.sql("select 0.0d as x, 4.0d as y").select(
        box_cox(F.col("x"), 0.0).alias("log"), box_cox(F.col("x"), 0.5).alias("root"), box_cox(F.col("y"), 0.5).alias("y"), box_cox(F.col("x"), 1.1).alias("same")
    ).first()
    assert (row["log"], row["root"], row["y"], row["same"]) == (float("-inf"), -2.0, 2.0, 0.0)


def test_one_hot_appends_one_column_per_value(spark):
    hot = one_hot(spark.createDataFrame([(1, "x"), (2, "y")], "g int, t string"), "g", [1, 2], "g")
    assert hot.columns == ["t", "g_1", "g_2"]
    assert sorted((r["g_1"], r["g_2"]) for r in hot.collect()) == [(0.0, 1.0), (1.0, 0.0)]


def test_model_sees_time_behaviour_and_group(make_logons):
    table = day(make_logons, {"ts": "2021-06-01 01:00:00"}).withColumn("group_id", F.lit(1))
    columns = model_columns(table)
    assert columns[0] == "weekday" and columns[-1] == "group_id" and "entity" not in columns and "bin" not in columns
