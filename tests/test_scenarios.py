"""Injected behaviour must rank first; whole analyses, stored models and streams."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loginlens.functions.timebin import TimeBin
from loginlens.operators import prep
from loginlens.operators.features import extract_features
from loginlens.operators.rank import rank_first
from loginlens.plans.analysis import Models, Options, features_of, find_anomalies, group_drift, group_features, statistics_of
from loginlens.session import new_shared_path
from loginlens.streaming.features import clean_stream, end_stream, open_bins, read_stream_output, stream_features, stream_logons, write_stream

SUSPECT = "20007"
START, END = "2021-06-01", "2021-06-22"


@pytest.fixture(scope="module")
def baseline(spark):
    """Forty accounts on their own hosts, three to six logons every weekday for three weeks."""
    days, per_day = 21, 6
    grid = spark.range(40 * days * per_day).select(
        (F.col("id") % 40).alias("user"), (F.floor(F.col("id") / 40) % days).alias("day"), F.floor(F.col("id") / (40 * days)).alias("n")
    )
    used = grid.filter((F.weekday(F.date_add(F.lit(START).cast("date"), F.col("day").cast("int"))) < 5) & (F.col("n") < 3 + (F.col("user") + F.col("day")) % 4))
    second = F.col("day") * 86400 + 7 * 3600 + F.col("n") * 5400 + (F.col("user") * 97 + F.col("day") * 31) % 1800
    return used.select(
        F.lit(4624).alias("event_code"),
        F.concat(F.lit("H"), (F.col("user") + F.when(F.col("n") == 2, 1).otherwise(0)).cast("string")).alias("host"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(START), "yyyy-MM-dd") + second).alias("ts"),
        F.col("n").alias("logon_id"),
        (20000 + F.col("user")).cast("string").alias("account"),
        F.concat(F.lit("S"), (F.col("user") % 9).cast("string")).alias("source"),
        F.lit(0).alias("source_port"),
        F.when(F.col("n") == 1, 3).otherwise(2).alias("logon_type"),
    ).cache()


def injected(spark, n, first, minutes, hosts=1, kind=2, source="S0", account=SUSPECT):
    i = F.col("id")
    return spark.range(1, n + 1).select(
        F.lit(4624).alias("event_code"),
        F.concat(F.lit("H"), (i % hosts).cast("string")).alias("host"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(first)) + i * minutes * 60).alias("ts"),
        i.alias("logon_id"),
        F.lit(account).alias("account"),
        F.lit(source).alias("source"),
        F.lit(0).alias("source_port"),
        F.lit(kind).alias("logon_type"),
    )


SCENARIOS = {
    "many_hosts": (dict(n=50, first="2021-06-15 00:00:00", minutes=15, hosts=50), TimeBin()),
    "weekend": (dict(n=50, first="2021-06-13 00:00:01", minutes=15), TimeBin()),
    "late_hours": (dict(n=40, first="2021-06-15 22:00:00", minutes=2), TimeBin("h", 6)),
    "remote_logons": (dict(n=20, first="2021-06-15 10:02:02", minutes=20, kind=10, source="S77"), TimeBin()),
    "new_account_everywhere": (dict(n=110, first="2021-06-16 00:00:00", minutes=10, hosts=110, kind=3, account="1234567"), TimeBin()),
}


@pytest.mark.parametrize("name", SCENARIOS)
@pytest.mark.parametrize("method", ["kNN", "IF"])
def test_injected_account_ranks_high(spark, baseline, name, method):
    what, time_bin = SCENARIOS[name]
    options = Options(start=START, end=END, time_bin=time_bin, method=method, rank="first", clusters=4, restarts=1)
    events = prep.add_activity(baseline, injected(spark, **what))
    top = [r["entity"] for r in find_anomalies(events, options).limit(3).collect()]
    assert what.get("account", SUSPECT) in top


def test_stored_models_score_new_days(spark, baseline):
    path = new_shared_path(spark, "models")
    common = dict(method="IF", rank="first", clusters=4, restarts=1)
    find_anomalies(baseline, Options(start=START, end="2021-06-15", **common), save_to=path)
    later = prep.add_activity(baseline, injected(spark, 50, "2021-06-15 00:00:00", 15, hosts=50))
    options = Options(start="2021-06-15", end=END, **common)
    found = find_anomalies(later, options, load_from=path).select("entity", "bin", "scores").collect()
    models = Models.load(path, "IF")
    scaled, merged = group_features(features_of(later, options), options, models)
    # The new day's many hosts widen the stored bounds, so ordinary rows move too.
    assert merged.bounds["Hosts_per_User"][1] > models.bounds["Hosts_per_User"][1]
    by_hand = rank_first(models.detector.transform(scaled), higher_is_worse=False).select("entity", "bin", "scores").collect()
    assert found == by_hand and len(found) == 40
    with pytest.raises(ValueError):
        Models.load(path, "kNN")


def test_group_drift_counts_visits_and_changes(spark, baseline):
    params = {"num_trees": 10, "max_depth": 4}
    path = new_shared_path(spark, "drift")
    visits = group_drift(baseline, Options(method="RF", start=START, end=END, clusters=4, restarts=1, params=params), save_to=path)
    assert visits.count() == 40 and visits.agg(F.min("visited_groups")).first()[0] >= 1
    again = Options(method="RF", start=START, end=END, group_changes=True)
    changes = group_drift(baseline, again, load_from=path)
    assert changes.columns == ["entity", "changed_groups"] and changes.count() == 40


def test_absence_and_empty_ranges_do_not_fail(spark, baseline):
    gone = prep.remove_activity(baseline, spark.createDataFrame([(SUSPECT,)], "account string"), "2021-06-07", "2021-06-21")
    features = extract_features(prep.clean(gone), START, END)
    bins = {r["bin"] for r in features.filter(F.col("entity") == SUSPECT).collect()}
    assert 20 in bins and not bins & set(range(6, 20))
    assert extract_features(prep.clean(gone), "2020-01-01", "2020-02-01").count() == 0


def test_statistics_before_and_after_cleaning(baseline):
    doubled = baseline.union(baseline)
    tables = statistics_of(doubled, Options(span="full"))
    n = baseline.count()
    assert tables["pre"]["logon_types"].agg(F.sum("count")).first()[0] == 2 * n
    assert tables["post"]["logon_types"].agg(F.sum("count")).first()[0] == n
    assert tables["post"]["days"].agg(F.sum("count")).first()[0] == n


@pytest.mark.parametrize("options", [dict(method="SVM"), dict(rank="x"), dict(rank="v", view="host"), dict(clusters=1)])
def test_options_are_checked(options):
    with pytest.raises(ValueError):
        Options(**options)


def test_stream_in_parts_equals_batch_on_closed_bins(spark, baseline):
    """Repeated events, five-hour bins and one file per trigger."""
    path, five = new_shared_path(spark, "in"), TimeBin("h", 5)
    for first, last in (("2021-06-01", "2021-06-03"), ("2021-06-03", "2021-06-08"), ("2021-06-08", "2021-06-11")):
        part = prep.in_range(baseline, first, last)
        part.union(part).coalesce(1).write.mode("append").parquet(path)
    cleaned = clean_stream(stream_logons(spark, path, 1))
    out = new_shared_path(spark, "out")
    write_stream(stream_features(cleaned, START, "2021-06-11", "host", five), out, new_shared_path(spark, "state")).awaitTermination()
    closed = read_stream_output(spark, out)
    events = prep.clean(baseline)
    batch = extract_features(events, START, "2021-06-11", "host", five)
    newest = closed.agg(F.max("bin")).first()[0]
    assert closed.count() > 0
    assert closed.exceptAll(batch).count() == 0
    assert batch.filter(F.col("bin") <= newest).exceptAll(closed).count() == 0
    rest = open_bins(events, closed, START, "2021-06-11", "host", five)
    assert closed.unionByName(rest).exceptAll(batch).count() == 0 and closed.count() + rest.count() == batch.count()


def test_end_mark_hands_out_open_bins_and_empties_the_state(spark, baseline):
    """After a restart, from state alone: the events' files are gone when the stream goes on. Nothing is kept after it."""
    path, five = new_shared_path(spark, "in"), TimeBin("h", 5)
    out, state = new_shared_path(spark, "out"), new_shared_path(spark, "state")
    prep.in_range(baseline, START, "2021-06-04").coalesce(1).write.parquet(path)
    features = stream_features(clean_stream(stream_logons(spark, path, 1)), START, "2021-06-04", "host", five)
    first = write_stream(features, out, state)
    first.awaitTermination()
    batch = extract_features(prep.clean(baseline), START, "2021-06-04", "host", five)
    assert read_stream_output(spark, out).count() < batch.count()
    assert sum(s["numRowsTotal"] for s in first.lastProgress["stateOperators"]) > 0
    for name in Path(path).glob("*.parquet"):
        name.unlink()
    end_stream(spark, path)
    second = write_stream(features, out, state)
    second.awaitTermination()
    found = read_stream_output(spark, out)
    batch = extract_features(prep.clean(prep.in_range(baseline, START, "2021-06-04")), START, "2021-06-04", "host", five)
    assert found.count() == batch.count() and found.exceptAll(batch).count() == 0
    assert sum(s["numRowsTotal"] for s in second.lastProgress["stateOperators"]) == 0


def test_stream_state_is_kept_on_disk(spark, baseline):
    """In memory it would grow with a micro-batch's events. A stream begun with another store goes on with that."""
    path, day = new_shared_path(spark, "in"), TimeBin("h", 24)
    prep.in_range(baseline, START, "2021-06-03").coalesce(1).write.parquet(path)
    features = stream_features(clean_stream(stream_logons(spark, path, 1)), START, "2021-06-03", "host", day)
    provider, found = "spark.sql.streaming.stateStore.providerClass", []
    for own in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        out, state = new_shared_path(spark, "out"), new_shared_path(spark, "state")
        if own:
            spark.conf.set(provider, own)
        try:
            write_stream(features, out, state).awaitTermination()
            assert spark.conf.get(provider, None) == own
        finally:
            spark.conf.unset(provider)
        if own:
            end_stream(spark, path)
            write_stream(features, out, state).awaitTermination()
        files = {f.suffix for f in Path(state, "state").rglob("*") if f.is_file()}
        assert (".delta" in files, ".zip" in files) == (bool(own), not own)
        found.append(read_stream_output(spark, out))
    assert found[1].exceptAll(extract_features(prep.clean(prep.in_range(baseline, START, "2021-06-03")), START, "2021-06-03", "host", day)).count() == 0
    assert 0 < found[0].count() < found[1].count() and found[0].exceptAll(found[1]).count() == 0
