"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlens.session import new_shared_path, shared_dir

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Most bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 4 << 20
CLEANUP_CONFS = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_small_batches(spark: SparkSession) -> SparkSession:
    """Let batches for Python workers hold BATCH_BYTES at most, from now on in this session.

    By default they hold up to 64 MB, of which every task and every worker it feeds keeps copies.
    """
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written once as Parquet in the shared folder and read back.

    Spark may delete the shuffle files of the write as soon as the table is there: a lost executor then costs a
    reread of the table, not a recomputation of what came before.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    old = {c: spark.conf.get(c, None) for c in CLEANUP_CONFS}
    try:
        for c in CLEANUP_CONFS:
            spark.conf.set(c, "true")
        df.write.parquet(path)
    finally:
        for c, value in old.items():
            spark.conf.unset(c) if value is None else spark.conf.set(c, value)
    return spark.read.schema(df.schema).parquet(path)


def delete_stored(df: DataFrame) -> None:
    """Remove a table made by ``stored`` that nothing reads any more; other tables are left alone."""
    spark = df.sparkSession
    own = f"{shared_dir(spark).rstrip('/')}/loginlens/"
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/loginlens/" in path and path.split(":", 1)[-1].lstrip("/").startswith(own.split(":", 1)[-1].lstrip("/")):
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def text_slices(texts: Sequence[bytes], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes together; a longer text is a range of its own."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (multiply and fold, twice)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_values() -> np.ndarray:
    """A fixed odd 64-bit value for each byte."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = sum of values[data[k]] * BASE**k for i <= k < j."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * powers(len(data), BASE), out=out[1:])
    return out


def only_when(condition, column):
    return F.when(condition, column)
