"""Mergeable totals: roll-up against direct totals, merged batches, and the error of the sketches."""

import pytest
from pyspark.sql import functions as F

from loginlens.functions.timebin import TimeBin
from loginlens.operators import rollup
from loginlens.operators.features import extract_features

START, END = "2021-06-01", "2021-06-07"


@pytest.fixture(scope="module")
def events(make_logons):
    rows = [
        {"ts": f"2021-06-{1 + i % 6:02d} {i * 7 % 24:02d}:{i % 60:02d}:{i % 53:02d}", "account": str(20000 + i % 4),
         "host": None if i % 11 == 0 else f"H{i * 5 % 37}", "source": None if i % 4 == 1 else f"S{i % 9}", "type": (2, 3, 12)[i % 3]}
        for i in range(900)
    ]
    return make_logons(rows).cache()


def same(a, b):
    return a.count() == b.count() and a.select(b.columns).exceptAll(b).count() == 0


@pytest.mark.parametrize("view", ["user", "host", "source"])
def test_rolled_up_features_equal_exact_ones(events, view):
    narrow, wide = TimeBin("dh", 3), TimeBin("dh", 12)
    totals = rollup.mergeable_totals(events, START, END, view, narrow)
    found = rollup.features_of_totals(rollup.roll_up(totals, narrow, wide), START, view, wide)
    assert same(found, extract_features(events, START, END, view, wide))
    exact = rollup.features_of_totals(totals, START, view, narrow)
    assert same(exact, extract_features(events, START, END, view, narrow))


def test_batches_add_up(events):
    third = F.pmod(F.xxhash64("ts", "account", "host"), F.lit(3))
    parts = [rollup.mergeable_totals(events.filter(third == i), START, END) for i in range(3)]
    found = rollup.features_of_totals(rollup.add_totals(*parts), START)
    assert same(found, extract_features(events, START, END))


def test_error_of_many_values_and_of_their_union(spark):
    values = spark.range(200_000).select(
        F.lit(4624).alias("event_code"), F.concat(F.lit("H"), F.col("id") % 60_000).alias("host"),
        F.timestamp_seconds(F.lit(1_622_505_600) + F.col("id") % 86_400).alias("ts"), F.lit("20001").alias("account"),
        F.lit(None).cast("string").alias("source"), F.lit(1).alias("source_port"), F.lit(3).alias("logon_type"),
    )
    narrow, wide = TimeBin("dh", 2), TimeBin("dh", 24)
    totals = rollup.mergeable_totals(values, START, "2021-06-02", "user", narrow)
    rolled = rollup.features_of_totals(rollup.roll_up(totals, narrow, wide), START, "user", wide).first()
    direct = rollup.features_of_totals(rollup.mergeable_totals(values, START, "2021-06-02", "user", wide), START, "user", wide).first()
    assert rolled["Hosts_per_User"] == pytest.approx(60_000, rel=0.03) and rolled["Sources_per_User"] == 1
    assert rolled["Hosts_per_User"] == pytest.approx(direct["Hosts_per_User"], rel=0.02)
    assert rolled["number_events"] == 200_000


def test_widths_must_fit_and_nothing_gives_nothing(events):
    totals = rollup.mergeable_totals(events.limit(0), START, END)
    assert rollup.features_of_totals(totals, START).count() == 0
    with pytest.raises(ValueError):
        rollup.roll_up(totals, TimeBin("h", 5), TimeBin())
