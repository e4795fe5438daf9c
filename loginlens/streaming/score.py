"""Scoring of closed bins with stored models.

A row's group follows from its entity's mean behaviour in all bins up to the row's own. Streams keep the sums for it, so
the scores do not depend on how the input was cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loginlens.operators.detector import DetectorModel
from loginlens.operators.grouping import GroupModel
from loginlens.operators.normalise import MinMax, normalise, running_sums, sums_to_means
from loginlens.schema import GROUP

ROW = "_row"


class RunningSums:
    """Exact sums and counts per entity over the micro-batches so far, as small tables under one folder.

    Micro-batch ``n`` writes the sums of its own rows to ``part=n``; every ``whole_every``-th one also writes the sums of
    all so far to ``whole=n``, and what only earlier ones need goes. Micro-batch ``n`` reads only what others before it
    wrote, so a repeated one finds and leaves the same tables.
    """

    def __init__(self, path: str, columns: list[str], whole_every: int = 16) -> None:
        if whole_every < 1:
            raise ValueError("whole_every must be at least 1")
        self.path, self.columns, self.every = path.rstrip("/"), list(columns), whole_every
        sums = [T.StructField(f"s_{i}", T.DecimalType(36, 9)) for i in range(len(columns))]
        counts = [T.StructField(f"n_{i}", T.LongType()) for i in range(len(columns))]
        self.schema = T.StructType([T.StructField("entity", T.StringType()), *sums, *counts])

    def before(self, spark: SparkSession, number: int) -> DataFrame:
        """Sums per entity of all micro-batches before this one."""
        whole = number // self.every * self.every - 1
        paths = [f"{self.path}/whole={whole}"] if whole >= 0 else []
        paths += [f"{self.path}/part={n}" for n in range(whole + 1, number)]
        if not paths:
            return spark.createDataFrame([], self.schema)
        parts = reduce(DataFrame.unionByName, [spark.read.schema(self.schema).parquet(p) for p in paths])
        return self._added(parts)

    def extend(self, batch: DataFrame, number: int) -> DataFrame:
        """The rows of the micro-batch with the sums ``s_i`` and counts ``n_i`` up to each one, this batch stored.

        An entity has one row per bin, and bins of later micro-batches are later ones.
        """
        spark = batch.sparkSession
        own = running_sums(batch, self.columns)
        total = batch.groupBy("entity").agg(
            *[F.sum(F.col(c).cast("decimal(26,9)")).cast("decimal(36,9)").alias(f"s_{i}") for i, c in enumerate(self.columns)],
            *[F.count(c).alias(f"n_{i}") for i, c in enumerate(self.columns)],
        )
        total.select(self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/part={number}")
        earlier = self.before(spark, number)
        if (number + 1) % self.every == 0:
            part = spark.read.schema(self.schema).parquet(f"{self.path}/part={number}")
            self._added(earlier.unionByName(part)).write.mode("overwrite").parquet(f"{self.path}/whole={number}")
            self._forget(spark, number - self.every)
        names = [f for f in self.schema.fieldNames() if f != "entity"]
        known = earlier.select("entity", *[F.col(c).alias(f"_{c}") for c in names])
        joined = own.join(known, "entity", "left")
        added = {c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in names}
        return joined.select(*batch.columns, *[v.cast(self.schema[c].dataType).alias(c) for c, v in added.items()])

    def _added(self, parts: DataFrame) -> DataFrame:
        names = [f for f in self.schema.fieldNames() if f != "entity"]
        sums = parts.groupBy("entity").agg(*[F.sum(c).cast(self.schema[c].dataType).alias(c) for c in names])
        return sums.select(self.schema.fieldNames())

    def _forget(self, spark: SparkSession, number: int) -> None:
        """Delete the tables that no micro-batch after ``number`` + ``whole_every`` - 1 reads."""
        old = [f"whole={number - self.every}", *[f"part={n}" for n in range(max(0, number - self.every + 1), number + 1)]]
        for name in old:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def attach_running_group(summed: DataFrame, columns: list[str], groups: GroupModel) -> DataFrame:
    """``columns`` of rows with running sums of the model's features, and the group of the means up to each row."""
    means = sums_to_means(summed.withColumn(ROW, F.struct(*columns)).drop(*columns), groups.columns)
    found = groups.assign(means)
    return found.select(f"{ROW}.*", GROUP)


def score_with_running_groups(features: DataFrame, groups: GroupModel, bounds: MinMax, detector: DetectorModel) -> DataFrame:
    """Scores of a whole feature table, each row grouped by its entity's bins up to its own."""
    grouped = attach_running_group(running_sums(features, groups.columns), features.columns, groups)
    return detector.transform(normalise(grouped, bounds))


def scorer(groups: GroupModel, bounds: MinMax, detector: DetectorModel, state: str) -> Callable[[DataFrame, int], DataFrame]:
    """The same for micro-batches, by their numbers; ``state`` is the stream's own folder for running sums."""
    sums = RunningSums(state, groups.columns)

    def score(batch: DataFrame, number: int) -> DataFrame:
        grouped = attach_running_group(sums.extend(batch, number), batch.columns, groups)
        return detector.transform(normalise(grouped, bounds))

    return score
