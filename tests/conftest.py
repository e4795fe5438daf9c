"""A small local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loginlens.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions=4,
        spark__driver__memory="4g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_logons(spark):
    """Logon rows from (account, time text, host, source, type) tuples, with defaults."""
    from pyspark.sql import functions as F

    from loginlens.schema import LOGON_SCHEMA

    def build(rows):
        full = [
            (4624, r.get("host", "H1"), r["ts"], r.get("logon_id", i), r.get("account", "20000"), r.get("source", "S1"), r.get("port", 0), r.get("type", 2))
            for i, r in enumerate(rows)
        ]
        text = spark.createDataFrame(full, "event_code int, host string, t string, logon_id long, account string, source string, source_port int, logon_type int")
        return text.withColumn("ts", F.col("t").cast("timestamp")).select(LOGON_SCHEMA.fieldNames())

    return build
