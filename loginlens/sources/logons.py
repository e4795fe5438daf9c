"""Raw logon events from headerless CSV or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from loginlens.schema import LOGON_COLUMNS, LOGON_EVENT_CODE, LOGON_SCHEMA, RAW_NAMES

# As the file stores them: time and logon id stay text until parsed below.
CSV_SCHEMA = T.StructType(
    [T.StructField(f.name, T.StringType() if f.name in ("ts", "logon_id") else f.dataType) for f in LOGON_SCHEMA]
)


def parse_time(text: Column) -> Column:
    """UTC timestamp from text, with or without a trailing ``UTC``; NULL when it is no time."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r"\s*UTC$", ""))


def parse_logon_id(text: Column) -> Column:
    """Number from decimal or ``0x`` text; 64-bit ids keep their bits."""
    hexadecimal = F.conv(F.regexp_replace(text, "^0[xX]", ""), 16, -10).try_cast("long")
    return F.when(text.rlike("^0[xX]"), hexadecimal).otherwise(text.try_cast("double").try_cast("long"))


def read_logons(
    spark: SparkSession,
    path: str | list[str],
    file_format: str | None = None,
    event_code: int | None = LOGON_EVENT_CODE,
    min_rows: int | None = None,
) -> DataFrame:
    """Typed logon events, by default only successful logons.

    A row with a wrong number of columns or a wrong type fails the job. ``min_rows`` counts the
    rows before the event filter, which costs one more pass.
    """
    paths = [path] if isinstance(path, str) else list(path)
    file_format = file_format or ("csv" if all(p.rstrip("/*").endswith(".csv") for p in paths) else "parquet")
    if file_format == "csv":
        raw = spark.read.schema(CSV_SCHEMA).option("mode", "FAILFAST").csv(paths)
    elif file_format == "parquet":
        raw = spark.read.parquet(*paths)
    else:
        raise ValueError(f"logon events are read from csv or parquet, not {file_format!r}")
    if min_rows is not None and raw.limit(min_rows).count() < min_rows:
        raise ValueError(f"fewer than {min_rows} rows")
    logons = to_logon_schema(raw)
    return logons if event_code is None else logons.filter(F.col("event_code") == event_code)


def to_logon_schema(raw: DataFrame) -> DataFrame:
    """Rename and type any table that has the eight logon columns, under either naming."""
    renamed = dict(zip(RAW_NAMES, LOGON_COLUMNS))
    df = raw.withColumnsRenamed({c: renamed[c] for c in raw.columns if c in renamed})
    missing = [c for c in LOGON_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing logon columns {missing}")
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for field in LOGON_SCHEMA:
        column, is_text = F.col(field.name), isinstance(types[field.name], T.StringType)
        if field.name == "ts" and is_text:
            column = parse_time(column)
        elif field.name == "logon_id" and is_text:
            column = parse_logon_id(column)
        elif types[field.name] != field.dataType:
            column = column.cast(field.dataType)
        columns.append(column.alias(field.name))
    return df.select(columns)


def write_logons(logons: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Headerless CSV in the export's column order, or Parquet."""
    if file_format == "csv":
        stamped = logons.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        stamped.select(LOGON_COLUMNS).write.csv(path)
    else:
        logons.select(LOGON_COLUMNS).write.parquet(path)


def write_by_time(logons: DataFrame, path: str, partitions: int | None = None) -> None:
    """Lay the events out in time order, one folder per day, so that date ranges prune whole files."""
    keys = [F.to_date("ts"), F.col("ts")]
    ranged = logons.repartitionByRange(partitions, *keys) if partitions else logons.repartitionByRange(*keys)
    ranged.withColumn("day", F.to_date("ts")).sortWithinPartitions("day", "ts").write.partitionBy("day").parquet(path)
