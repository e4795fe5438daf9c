"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "loginlens", master: str | None = None, **conf: object) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Calendar arithmetic is defined in UTC; pin the session to it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, from the session's settings.

    A folder of our own is made only in local mode and only when the session names none.
    """
    context = spark.sparkContext
    configured = context.getConf().get(CHECKPOINT_CONF, None) or spark.conf.get(CHECKPOINT_CONF, None)
    active = context.getCheckpointDir()
    if configured:
        if active is None:
            context.setCheckpointDir(configured)
        return configured
    if active:
        return active.rsplit("/", 1)[0]
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="run-")
    context.setCheckpointDir(folder)
    return folder


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to yet."""
    return f"{shared_dir(spark).rstrip('/')}/loginlens/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written once as Parquet in the shared folder and read back, for tables with many readers."""
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_partitions(df: DataFrame, rows: int, rows_per_partition: int = 50_000) -> DataFrame:
    """No more partitions than the rows are worth, for algorithms that run many short jobs."""
    return df.coalesce(max(1, -(-rows // rows_per_partition)))


def broadcast_if_bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast hint when a look at the table shows no more than ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def broadcast_if_small(df: DataFrame, rows: int, max_rows: int = 200_000) -> DataFrame:
    """Broadcast hint for a side whose row count is known and small; else leave it to the optimiser."""
    return F.broadcast(df) if rows <= max_rows else df
