"""Groups of entities with similar mean behaviour."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlens.operators.kmeans import TASK_ROWS, fit_centres
from loginlens.operators.normalise import entity_means
from loginlens.schema import GROUP
from loginlens.session import broadcast_if_small, few_partitions, materialise

VECTOR = "_vector"
MODEL_FIELDS = "columns string, centres string, cost double"


@dataclass
class GroupModel:
    """Centres of groups numbered 1..k in the order of the centres.

    The number is itself a feature, so it must not depend on the order in which the clusters
    happened to be found.
    """

    centres: list[list[float]]
    columns: list[str]
    cost: float | None = None

    def assign(self, means: DataFrame) -> DataFrame:
        """Nearest group of every entity, for known and for new entities; of equally near ones the first.

        Means that are null or not finite raise.
        """
        missing = [c for c in self.columns if c not in means.columns]
        if missing:
            raise ValueError(f"the group model needs the features {missing}")
        values = [F.col(c).cast("double") for c in self.columns]
        gaps = [sum((F.pow(v - F.lit(x), 2) for v, x in zip(values, centre)), F.lit(0.0)) for centre in self.centres]
        nearest = F.array_min(F.array(*[F.struct(gap.alias("gap"), F.lit(i + 1).alias("group")) for i, gap in enumerate(gaps)]))
        usable = reduce(and_, [F.coalesce(F.abs(v) < float("inf"), F.lit(False)) for v in values])
        return means.withColumn(GROUP, F.when(usable, nearest["group"]).otherwise(F.raise_error("means must be finite").cast("int")))

    def save(self, path: str) -> None:
        row = (json.dumps(self.columns), json.dumps(self.centres), self.cost)
        spark = SparkSession.active()
        spark.createDataFrame([row], MODEL_FIELDS).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")

    @classmethod
    def load(cls, path: str) -> "GroupModel":
        row = SparkSession.active().read.schema(MODEL_FIELDS).parquet(f"{path}/centres").first()
        return cls(json.loads(row["centres"]), json.loads(row["columns"]), row["cost"])


def as_vector(df: DataFrame, columns: Sequence[str], name: str = VECTOR) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name, handleInvalid="error").transform(df)


def fit_groups(means: DataFrame, k: int = 13, seed: int = 123, restarts: int = 100, max_iter: int = 50) -> GroupModel:
    """k-means on the un-normalised means, the best of several starts; k is at most the number of entities."""
    if k < 2:
        raise ValueError("at least two groups are needed")
    columns = [c for c in means.columns if c != "entity"]
    vectors = means.select("entity", F.array(*[F.col(c).cast("double") for c in columns]).alias(VECTOR)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = vectors.count()
        if n < 2:
            raise ValueError("grouping needs at least two entities")
        tasks = -(-n // TASK_ROWS)
        # The passes are worth more tasks than the rows, which are small; few rows stay as they are.
        rows = few_partitions(vectors, n) if tasks == 1 else vectors.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            centres, cost = fit_centres(rows, VECTOR, min(k, n), restarts, max_iter, seed)
        finally:
            if tasks > 1:
                rows.unpersist()
        return GroupModel(centres.tolist(), columns, cost)
    finally:
        vectors.unpersist()


def attach_group(features: DataFrame, groups: DataFrame, entities: int | None = None) -> DataFrame:
    """Add each entity's group to its rows, as the last column.

    The groups are broadcast only when their known number is small.
    """
    groups = groups.select("entity", GROUP)
    side = groups if entities is None else broadcast_if_small(groups, entities)
    return features.join(side, "entity", "left").select(*features.columns, GROUP)


def visited_groups(grouped: DataFrame) -> DataFrame:
    """Number of different groups per entity, most first."""
    visits = grouped.groupBy("entity").agg(F.count_distinct(GROUP).alias("visited_groups"))
    return visits.orderBy(F.desc("visited_groups"), "entity")


def group_weights(labelled: DataFrame) -> DataFrame:
    """Share of entities per group."""
    counts = labelled.groupBy(GROUP).agg(F.count("*").alias("n"))
    total = labelled.agg(F.count("*").alias("n")).first()["n"]
    return counts.select(GROUP, (F.col("n") / F.lit(total)).alias("weight"))


def labelled_means(features: DataFrame, model: GroupModel, leave_out: Sequence[str] = ()) -> DataFrame:
    """Un-normalised entity means with the group as label."""
    return model.assign(entity_means(features, leave_out))


def spectral_groups(means: DataFrame, k: int = 13, neighbours: int = 10, seed: int = 123, max_iter: int = 20) -> DataFrame:
    """Groups by power-iteration clustering of the entities' nearest-neighbour graph.

    Edges carry a Gaussian similarity of the distance, scaled by the mean neighbour distance.
    This needs all entities at once: new entities cannot be assigned later.
    """
    from loginlens.operators.knn import knn_pairs

    columns = [c for c in means.columns if c != "entity"]
    numbered = means.select(
        "entity", F.array(*[F.col(c).cast("double") for c in columns]).alias("vector")
    )
    distinct = numbered.groupBy("vector").agg(F.min("entity").alias("entity"))
    if distinct.limit(k + 1).count() <= k:
        raise ValueError("fewer distinct entities than groups")
    pairs = knn_pairs(distinct, key="entity", vector="vector", k=neighbours).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scale = pairs.agg(F.avg("distance")).first()[0] or 1.0
        ids = materialise(distinct.select("entity", F.monotonically_increasing_id().alias("id")))
        weight = F.exp(-F.pow(F.col("distance") / F.lit(scale), 2) / 2)
        edges = (
            pairs.join(ids, "entity")
            .join(ids.select(F.col("entity").alias("neighbour"), F.col("id").alias("other")), "neighbour")
            .select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"), weight.alias("weight"))
            .filter("src <> dst")
            .groupBy("src", "dst")
            .agg(F.max("weight").alias("weight"))
        )
        clustering = PowerIterationClustering(k=k, maxIter=max_iter, initMode="degree", weightCol="weight")
        found = clustering.assignClusters(edges).join(ids, "id")
        firsts = found.groupBy("cluster").agg(F.min("entity").alias("first")).orderBy("first").collect()
        mapping = [x for i, r in enumerate(firsts) for x in (F.lit(r["cluster"]), F.lit(i + 1))]
        numbers = F.element_at(F.create_map(*mapping), F.col("cluster"))
        per_vector = found.select("entity", numbers.alias(GROUP)).join(distinct, "entity").select("vector", GROUP)
        return numbered.join(per_vector, "vector").select("entity", GROUP)
    finally:
        pairs.unpersist()
