"""Logon events derived from the driver's ``events`` table, in Spark and in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlens.session import use_utc

LOGONS_SQL = """
logons as (
  select cast(case when event_type = 'error' and k < 10 then 4625 else 4624 end as int) as event_code,
         'H' || cast(k % 20 as varchar) as host,
         cast(ts as timestamp) as ts,
         cast(event_id + 1000000000000 * copy as bigint) as logon_id,
         cast(user_id + 9990 as varchar) as account,
         case when k = 7 then null else 'S' || cast((event_id * 7) % 15 as varchar) end as source,
         cast(case when k = 3 then null else (event_id * 7919) % 65536 end as int) as source_port,
         cast(case event_type when 'view' then 2 when 'click' then 3 when 'signup' then 10
                              when 'purchase' then case when k = 11 then null else 9 end
                              else 11 + k % 2 end as int) as logon_type
  from (select e.*, c.copy, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k
        from events e cross join (select 0 as copy union all select 1) c)
  where copy = 0 or k < 5
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def logons_from(events: DataFrame) -> DataFrame:
    """Every event as a logon; some occur twice under another logon id, so that deduplication has work."""
    k = F.col("k")
    numbered = events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    copies = numbered.withColumn("copy", F.explode(F.when(k < 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    kind = F.col("event_type")
    return copies.select(
        F.when((kind == "error") & (k < 10), 4625).otherwise(4624).cast("int").alias("event_code"),
        F.concat(F.lit("H"), (k % 20).cast("string")).alias("host"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") + F.lit(1_000_000_000_000) * F.col("copy")).cast("long").alias("logon_id"),
        (F.col("user_id") + 9990).cast("string").alias("account"),
        F.when(k == 7, None).otherwise(F.concat(F.lit("S"), ((F.col("event_id") * 7) % 15).cast("string"))).alias("source"),
        F.when(k == 3, None).otherwise((F.col("event_id") * 7919) % 65536).cast("int").alias("source_port"),
        F.when(kind == "view", 2)
        .when(kind == "click", 3)
        .when(kind == "signup", 10)
        .when(kind == "purchase", F.when(k == 11, None).otherwise(9))
        .otherwise(11 + k % 2)
        .cast("int")
        .alias("logon_type"),
    )


def logons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logons_from(table(spark, sf_dir, "events"))


def dates(spark: SparkSession, sf_dir: str) -> tuple[dt.date, dt.date]:
    """First day of the events and the day after the last one."""
    row = table(spark, sf_dir, "events").agg(
        F.to_date(F.min("ts")).alias("lo"), F.date_add(F.to_date(F.max("ts")), 1).alias("hi")
    ).first()
    return row["lo"], row["hi"]
