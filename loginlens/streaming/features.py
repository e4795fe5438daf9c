"""Features of time-ordered event streams; a bin is emitted once no event in time can add to it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.streaming import StreamingQuery

from loginlens.functions.timebin import TimeBin, as_date, utc_midnight, utc_timestamp
from loginlens.operators.features import extract_features, feature_columns, type_flag
from loginlens.operators.prep import drop_ignored_accounts, keep_events, with_entity
from loginlens.schema import DEDUP_COLUMNS, LOGON_EVENT_CODE, LOGON_SCHEMA, PROPORTION_SETS, VIEW_COUNTS

SPREAD = 32  # parts a busy entity's event count is kept in

# State grows with the events of a micro-batch, so it is kept on the executors' disks, with bounded memory for each executor.
STATE_CONFS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}

#: Time of the event that ends a stream, later than any other.
END_OF_STREAM = dt.datetime(9000, 1, 1)


def stream_logons(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of logon events as they arrive."""
    reader = spark.readStream.schema(LOGON_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def clean_stream(
    logons: DataFrame, delay: str = "1 hour", ignore_accounts: tuple[int, int] | None = (0, 10_000)
) -> DataFrame:
    """Successful logons without ignored accounts and without repeats; later events than ``delay`` are dropped.

    The end mark of ``end_stream`` moves the watermark but is no event. The filter that leaves it out names the time, so
    Spark keeps it after the watermark.
    """
    kept = keep_events(logons)
    kept = drop_ignored_accounts(kept, *ignore_accounts) if ignore_accounts else kept
    timed = kept.withWatermark("ts", delay).filter(F.col("ts") < utc_timestamp(END_OF_STREAM))
    return timed.dropDuplicatesWithinWatermark(DEDUP_COLUMNS).select(DEDUP_COLUMNS)


def end_stream(spark: SparkSession, path: str) -> None:
    """End the stream of the Parquet files under ``path``: its next run hands out the bins that are still open.

    A file with one event later than all others closes every bin by event time, out of the state that the stream keeps, and
    so empties that state; no event is read again. Whatever comes after it is late. It has to be the newest file.
    """
    values = {"event_code": F.lit(LOGON_EVENT_CODE), "ts": utc_timestamp(END_OF_STREAM), "account": F.lit("end of stream")}
    mark = spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LOGON_SCHEMA])
    mark.coalesce(1).write.mode("append").parquet(path)


def stream_features(
    cleaned: DataFrame,
    start: dt.date | str,
    end: dt.date | str | None = None,
    view: str = "user",
    time_bin: TimeBin = TimeBin(),
    proportions: Sequence[Sequence[int]] = tuple(PROPORTION_SETS),
) -> DataFrame:
    """The columns of the batch feature table, one row per entity and closed bin.

    Streams have no distinct counts. Each event is therefore counted under three headings (the
    event itself and both counted values); a second aggregation counts the values per heading, NULL
    being one of them. State per key has a fixed size, however busy an entity is.
    """
    first = as_date(start)
    events = cleaned.filter(F.col("ts") >= utc_midnight(first))
    if end is not None:
        events = events.filter(F.col("ts") < utc_timestamp(time_bin.stop(first, as_date(end))))
    events = with_entity(events, view)

    counted = VIEW_COUNTS[view]
    spread = F.pmod(F.xxhash64(*DEDUP_COLUMNS), F.lit(SPREAD)).cast("string")
    headings = [F.struct(F.lit("event").alias("heading"), spread.alias("value"))] + [
        F.struct(F.lit(name).alias("heading"), F.col(column).alias("value")) for name, column in counted
    ]
    parts = events.select("entity", "ts", "logon_type", F.explode(F.array(*headings)).alias("part"))

    hours = time_bin.width_hours
    offset = int((first - dt.date(1970, 1, 1)).days * 24 % hours)
    width, shift = f"{hours} hours", f"{offset} hours"
    values = parts.groupBy(
        F.window("ts", width, width, shift).alias("window"),
        "entity",
        F.col("part.heading").alias("heading"),
        F.col("part.value").alias("value"),
    ).agg(
        F.count("*").alias("n"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
        *[F.sum(type_flag(p)).alias(f"t{i}") for i, p in enumerate(proportions)],
    )

    is_event = F.col("heading") == "event"

    def of_events(column: str) -> Column:
        return F.sum(F.when(is_event, F.col(column)).otherwise(0))

    totals = values.groupBy(F.window(F.window_time("window"), width, width, shift).alias("window"), "entity").agg(
        of_events("n").alias("number_events"),
        F.min("first").alias("_first"),
        F.max("last").alias("_last"),
        *[of_events(f"t{i}").alias(f"_t{i}") for i in range(len(proportions))],
        *[F.sum((F.col("heading") == name).cast("long")).alias(name) for name, _ in counted],
    )
    numbered = totals.withColumn("bin", time_bin.index(F.col("window.start"), first))
    return feature_columns(numbered, first, view, time_bin, proportions)


def write_stream(
    features: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame, int], DataFrame] | None = None
) -> StreamingQuery:
    """Append closed bins to Parquet, optionally after a transform of each micro-batch and its number, such as scoring.

    Every micro-batch owns one folder and overwrites it, so a repeated batch leaves no copies. State is kept as STATE_CONFS
    say, unless the session names a store of its own; a stream that was begun with another store goes on with that.
    """

    def store(batch: DataFrame, number: int) -> None:
        if transform is None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
            return
        # A transform may read its rows several times; the stateful steps before it should run once.
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            transform(batch, number).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    writer = features.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", checkpoint)
    conf = features.sparkSession.conf
    missing = [c for c in STATE_CONFS if conf.get(c, None) is None]
    try:
        # The query takes the session's settings as they are when it starts.
        for c in missing:
            conf.set(c, STATE_CONFS[c])
        return writer.trigger(availableNow=True).start()
    finally:
        for c in missing:
            conf.unset(c)


def read_stream_output(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def open_bins(
    cleaned: DataFrame,
    closed: DataFrame,
    start: dt.date | str,
    end: dt.date | str,
    view: str = "user",
    time_bin: TimeBin = TimeBin(),
    proportions: Sequence[Sequence[int]] = tuple(PROPORTION_SETS),
) -> DataFrame:
    """Batch features of the bins after the last closed one, to look at them while the stream goes on.

    This reads the events again; ``end_stream`` finishes a stream without that.
    """
    last = closed.agg(F.max("bin")).first()[0]
    rest = extract_features(cleaned, start, end, view, time_bin, proportions)
    return rest if last is None else rest.filter(F.col("bin") > last)
