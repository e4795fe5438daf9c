"""Run the registered queries and their SQL side by side: ``python -m checks.compare [sf_dir] [name …]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from checks.catalog import ORACLES, QUERIES
from loginlens.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES.split():
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool | None, str]:
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return None, f"{len(got)} rows"
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    wanted = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(columns)} vs {sorted(df.columns)}"
    if len(got) != len(wanted):
        return False, f"{len(got)} rows vs {len(wanted)}"
    differ = [(g, w) for g, w in zip(got, wanted) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    return not differ, f"{len(got)} rows" + (f", {len(differ)} differ: {differ[0]}" if differ else "")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        master="local[8]",
        spark__sql__shuffle__partitions=8,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            same, text = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            same, text = False, f"{type(error).__name__}: {str(error)[:400]}"
        bad += same is False
        mark = {True: "ok", False: "BAD", None: "rows"}[same]
        print(f"{mark:4} {name:34} {time.time() - start:6.1f}s  {text}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
