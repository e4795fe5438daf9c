"""Readers, writers and their checks."""

import pytest
from pyspark.sql import functions as F

from loginlens.session import new_shared_path
from loginlens.sources.features import check_feature_names, read_features, write_features
from loginlens.sources.logons import parse_logon_id, parse_time, read_logons, write_logons


def write_text(spark, lines):
    path = new_shared_path(spark, "text") + ".csv"
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    return path


def test_csv_rows_are_typed_and_filtered(spark):
    path = write_text(
        spark,
        ['4624,1112223,"2021-06-01 00:00:02",0x233eef,33339993,3333888,0,2', "4625,h,2021-06-01 00:00:02 UTC,17,u,,,3"],
    )
    row = read_logons(spark, path).collect()
    assert len(row) == 1 and row[0]["logon_id"] == 2309871 and row[0]["account"] == "33339993"
    other = read_logons(spark, path, event_code=4625).first()
    assert other["source"] is None and other["source_port"] is None and other["logon_id"] == 17
    assert read_logons(spark, path, event_code=None).count() == 2


@pytest.mark.parametrize("line", ["4624,h,2021-06-01 00:00:02,1,u,s,0", "x,h,2021-06-01 00:00:02,1,u,s,0,2"])
def test_malformed_rows_fail(spark, line):
    with pytest.raises(Exception):
        read_logons(spark, write_text(spark, [line])).collect()


def test_least_number_of_rows_counts_before_the_filter(spark):
    path = write_text(spark, ["4625,h,2021-06-01 00:00:02,1,u,s,0,2"] * 3)
    assert read_logons(spark, path, min_rows=3).count() == 0
    with pytest.raises(ValueError):
        read_logons(spark, path, min_rows=4)


def test_parquet_with_either_naming(spark, make_logons):
    path = new_shared_path(spark, "named")
    rows = make_logons([{"ts": "2021-06-01 08:00:00"}])
    names = ["Event_ID", "Host", "Time", "Logon_ID", "User", "Source", "Source_Port", "Logon_Type"]
    rows.toDF(*names).write.parquet(path)
    assert read_logons(spark, path).collect() == rows.collect()
    with pytest.raises(ValueError):
        read_logons(spark, path, file_format="orc")


def test_written_csv_reads_back(spark, make_logons):
    path = new_shared_path(spark, "csv") + ".csv"
    rows = make_logons([{"ts": "2021-06-01 08:00:00.123456", "source": None}, {"ts": "2021-06-01 08:00:01"}])
    write_logons(rows, path, "csv")
    assert sorted(read_logons(spark, path).collect()) == sorted(rows.collect())


def test_text_parsers(spark):
    row = spark.sql("select '0xFFFFFFFFFFFFFFFF' as big, 'abc' as bad, '12' as dec").select(
        parse_logon_id(F.col("big")).alias("big"), parse_logon_id(F.col("bad")).alias("bad"), parse_logon_id(F.col("dec")).alias("dec"), parse_time(F.col("bad")).alias("t")
    ).first()
    assert (row["big"], row["bad"], row["dec"], row["t"]) == (-1, None, 12, None)


def test_feature_names_are_checked(spark):
    check_feature_names(["entity", "bin", "weekday", "proportion_11_12", "ports"], extra=["ports"])
    with pytest.raises(ValueError):
        check_feature_names(["entity", "secret"])
    path = new_shared_path(spark, "bad")
    write_features(spark.createDataFrame([("a", 1)], "entity string, secret int"), path)
    with pytest.raises(ValueError):
        read_features(spark, path)
