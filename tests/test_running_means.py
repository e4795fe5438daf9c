"""Running means of entities: in batch, in micro-batches, repeated, and in scores of a stream."""

import os

import pytest
from pyspark.sql import functions as F

from loginlens.functions.timebin import TimeBin
from loginlens.operators import prep
from loginlens.operators.features import extract_features
from loginlens.operators.grouping import fit_groups
from loginlens.operators.iforest import IsolationForestDetector
from loginlens.operators.normalise import entity_means, min_max, normalise, running_means, running_sums, sums_to_means
from loginlens.session import new_shared_path
from loginlens.streaming.features import clean_stream, read_stream_output, stream_features, stream_logons, write_stream
from loginlens.streaming.score import RunningSums, attach_running_group, score_with_running_groups, scorer


def table(spark, rows):
    return spark.createDataFrame(rows, "entity string, bin long, weekday int, a double, b long")


def means_of(df):
    return sorted((r["entity"], r["bin"], r["a"], r["b"]) for r in df.select("entity", "bin", "a", "b").collect())


def some_rows():
    return [(f"e{i % 7}", i // 7, 1, 0.1 * (i * 37 % 11), i * 13 % 5) for i in range(140)]


def expected(rows):
    out = []
    for e, b, *_ in rows:
        own = [r for r in rows if r[0] == e and r[1] <= b]
        out.append((e, b, sum(r[3] for r in own) / len(own), sum(r[4] for r in own) / len(own)))
    return sorted(out)


def test_means_up_to_each_bin(spark):
    rows = some_rows()
    found = means_of(running_means(table(spark, rows)))
    for row, other in zip(found, expected(rows), strict=True):
        assert row[:2] == other[:2] and row[2:] == pytest.approx(other[2:])


@pytest.mark.parametrize("sizes", [[20], [3, 17], [1] * 20])
def test_micro_batches_add_up_and_may_be_repeated(spark, sizes):
    rows, first = some_rows(), 0
    whole = means_of(running_means(table(spark, rows)))
    state, found = RunningSums(new_shared_path(spark, "sums"), ["a", "b"], whole_every=3), []
    for number, bins in enumerate(sizes):
        batch = table(spark, [r for r in rows if first <= r[1] < first + bins])
        once = means_of(drop_inputs(state.extend(batch, number)))
        assert means_of(drop_inputs(state.extend(batch, number))) == once
        found, first = found + once, first + bins
    assert sorted(found) == whole


def drop_inputs(summed):
    return sums_to_means(summed.drop("a", "b"), ["a", "b"])


def test_empty_micro_batches_and_new_entities(spark):
    state, empty = RunningSums(new_shared_path(spark, "sums"), ["a", "b"], whole_every=2), table(spark, [])
    assert state.extend(empty, 0).count() == 0
    assert means_of(drop_inputs(state.extend(table(spark, [("x", 0, 1, 1.5, 2)]), 1))) == [("x", 0, 1.5, 2.0)]
    assert state.extend(empty, 2).count() == 0
    later = means_of(drop_inputs(state.extend(table(spark, [("x", 5, 1, 2.5, 4), ("y", 5, 1, 1.0, 1)]), 3)))
    assert later == [("x", 5, 2.0, 3.0), ("y", 5, 1.0, 1.0)]
    with pytest.raises(ValueError):
        RunningSums("x", ["a"], whole_every=0)


def test_stream_scores_do_not_depend_on_how_files_were_cut(spark, make_logons):
    rows = [
        {"ts": f"2021-06-{1 + i % 12:02d} {7 + i // 12 % 9:02d}:{i % 60:02d}:{i % 49:02d}", "account": str(20000 + i % 5), "host": f"H{i * 7 % (2 + i % 5)}", "type": (2, 3, 10)[i % 3], "port": i}
        for i in range(480)
    ]
    events = make_logons(rows).cache()
    start, end, day = "2021-06-01", "2021-06-13", TimeBin()
    features = extract_features(prep.clean(events), start, end, "user", day)
    groups, bounds = fit_groups(entity_means(features), k=3, restarts=2), min_max(features)
    grouped = attach_running_group(running_sums(features, groups.columns), features.columns, groups)
    detector = IsolationForestDetector(n_estimators=10).fit(normalise(grouped, bounds))
    batch = score_with_running_groups(features, groups, bounds, detector)
    assert {r["group_id"] for r in batch.select("group_id").distinct().collect()} <= {1, 2, 3}
    for files in (1, 4, 12) if os.environ.get("ALL_QUERIES") else (1, 4):
        path, out = new_shared_path(spark, "in"), new_shared_path(spark, "out")
        for first in range(0, 12, 12 // files):
            days = F.dayofmonth("ts") - 1
            events.filter((days >= first) & (days < first + 12 // files)).coalesce(1).write.mode("append").parquet(path)
        cleaned = clean_stream(stream_logons(spark, path, 1))
        score = scorer(groups, bounds, detector, new_shared_path(spark, "sums"))
        write_stream(stream_features(cleaned, start, end, "user", day), out, new_shared_path(spark, "state"), score).awaitTermination()
        found = read_stream_output(spark, out)
        newest = found.agg(F.max("bin")).first()[0]
        assert newest == 10
        due = batch.filter(F.col("bin") <= newest)
        assert found.count() == due.count() and found.exceptAll(due.select(found.columns)).count() == 0
