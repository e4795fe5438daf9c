"""Random forest over entity groups: how entities move between groups over time."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loginlens.functions.scaling import box_cox, box_cox_lambdas
from loginlens.operators.grouping import as_vector, group_weights
from loginlens.plans.params import check_params
from loginlens.schema import GROUP
from loginlens.session import materialise

VECTOR = "_inputs"
WEIGHT = "_weight"
UNLIMITED_DEPTH = 30  # the most MLlib grows

# The default parameters, and the full search grid apart from the mtry range.
DEFAULTS: dict[str, Any] = {
    "num_trees": 500,
    "mtry": 2,
    "min_node_size": 5,
    "sample_fraction": 0.7,
    "max_depth": 3,
    "seed": 123,
}
FULL_GRID = {"min_node_size": [3, 5, 7, 9], "sample_fraction": [0.55, 0.632, 0.70, 0.80], "max_depth": [5, 7, 9, 11, 13]}
SMALL_GRID = {"min_node_size": [3, 7], "sample_fraction": [0.632], "max_depth": [5, 9]}


@dataclass
class GroupForest:
    """A fitted forest with the transforms of its inputs."""

    forest: RandomForestClassificationModel
    columns: list[str]
    lambdas: dict[str, float]
    accuracy: float | None = None

    def predict(self, features: DataFrame, name: str = GROUP) -> DataFrame:
        """The group each row behaves like."""
        missing = [c for c in self.columns if c not in features.columns]
        if missing:
            raise ValueError(f"the features differ from the model's: missing {missing}")
        found = self.forest.transform(_inputs(features, self.columns, self.lambdas))
        return found.select(*[c for c in features.columns if c != name], F.col("prediction").cast("int").alias(name))

    def save(self, path: str) -> None:
        self.forest.write().save(f"{path}/forest")
        metadata = {"kind": "RF", "columns": self.columns, "lambdas": self.lambdas, "accuracy": self.accuracy}
        SparkSession.active().createDataFrame([(json.dumps(metadata),)], "value string").write.text(f"{path}/metadata")

    @classmethod
    def load(cls, path: str) -> "GroupForest":
        metadata = json.loads(SparkSession.active().read.text(f"{path}/metadata", wholetext=True).first()["value"])
        if metadata["kind"] != "RF":
            raise ValueError(f"the model in {path} is {metadata['kind']}, not RF")
        forest = RandomForestClassificationModel.load(f"{path}/forest")
        return cls(forest, metadata["columns"], metadata["lambdas"], metadata["accuracy"])


def _inputs(df: DataFrame, columns: Sequence[str], lambdas: dict[str, float]) -> DataFrame:
    scaled = {f"_x{i}": box_cox(F.col(c).cast("double"), lambdas[c]) if c in lambdas else F.col(c).cast("double") for i, c in enumerate(columns)}
    vectors = as_vector(df.withColumns(scaled), list(scaled), VECTOR)
    return vectors.drop(*scaled)


def _classifier(params: dict[str, Any]) -> RandomForestClassifier:
    check_params("RF", params)
    return RandomForestClassifier(
        featuresCol=VECTOR,
        labelCol=GROUP,
        weightCol=WEIGHT,
        numTrees=params["num_trees"],
        featureSubsetStrategy=str(params["mtry"]),
        minInstancesPerNode=params["min_node_size"],
        subsamplingRate=float(params["sample_fraction"]),
        maxDepth=params["max_depth"] or UNLIMITED_DEPTH,
        seed=params["seed"] if params["seed"] is not None else 0,
    )


def _training_rows(labelled: DataFrame) -> tuple[DataFrame, list[str], dict[str, float]]:
    """Entity, vector, label and class weight of every entity."""
    columns = [c for c in labelled.columns if c not in ("entity", GROUP)]
    lambdas = box_cox_lambdas(labelled, columns)
    # One weight per group: as many rows as there are clusters.
    weights = F.broadcast(group_weights(labelled).withColumnRenamed("weight", WEIGHT))
    rows = _inputs(labelled, columns, lambdas).join(weights, GROUP)
    return rows.select("entity", VECTOR, F.col(GROUP).cast("double").alias(GROUP), WEIGHT), columns, lambdas


def bootstrap_count(key: Column, bag: int, seed: int, share: float = 1.0) -> Column:
    """How often a row is drawn into a bag: a Poisson number with mean ``share``, by the hash of its key.

    The same row is drawn alike however the table is partitioned and whenever a task runs again.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(bag), key), F.lit(1 << 30)) / float(1 << 30)
    terms = [math.exp(-share) * share**n / math.factorial(n) for n in range(12)]
    return sum(((u >= sum(terms[: n + 1])).cast("int") for n in range(12)), F.lit(0))


def out_of_bag_votes(rows: DataFrame, params: dict[str, Any], bags: int = 10, key: str = "entity") -> DataFrame:
    """(key, label, class, votes) from trees that did not see the row.

    ``num_trees`` trees are grown in ``bags`` bags of rows; the trees of a bag differ by the features they try. A row
    gets votes from the bags it was not drawn into, each tree giving one vote spread over the classes of the leaf. Rows
    drawn into every bag have no votes. Rows with equal keys are drawn together.
    """
    params = {**DEFAULTS, **params}
    seed = params["seed"] or 0
    found = []
    for bag in range(bags):
        trees = params["num_trees"] // bags + (bag < params["num_trees"] % bags)
        if not trees:
            continue
        drawn = rows.withColumn("_drawn", bootstrap_count(F.col(key), bag, seed, float(params["sample_fraction"])))
        inside = drawn.filter("_drawn > 0").withColumn(WEIGHT, F.col(WEIGHT) * F.col("_drawn"))
        if inside.isEmpty():
            continue
        classifier = _classifier({**params, "num_trees": trees, "sample_fraction": 1.0, "seed": seed + bag}).setBootstrap(False)
        voted = classifier.fit(inside).transform(drawn.filter("_drawn = 0"))
        found.append(voted.select(key, F.col(GROUP).alias("label"), F.posexplode(vector_to_array("rawPrediction")).alias("class", "vote")))
    if not found:
        return rows.select(key, F.col(GROUP).alias("label"), F.lit(0).alias("class"), F.lit(0.0).alias("votes")).limit(0)
    # Few rows per bag reach the shuffle: one for every row and class.
    return reduce(DataFrame.unionByName, found).groupBy(key, "label", "class").agg(F.sum("vote").alias("votes"))


def out_of_bag_error(votes: DataFrame, key: str = "entity") -> DataFrame:
    """(rows, error): the share of rows whose most voted class is not theirs; of equal votes the smaller class counts."""
    best = votes.groupBy(key, "label").agg(F.min_by("class", F.struct(-F.col("votes"), F.col("class"))).alias("class"))
    return best.agg(F.count("*").alias("rows"), F.avg((F.col("class") != F.col("label")).cast("double")).alias("error"))


def _evaluator() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol=GROUP, metricName="accuracy")


def group_votes(labelled: DataFrame, params: dict[str, Any] | None = None, bags: int = 10) -> DataFrame:
    """Out-of-bag votes (entity, label, class, votes) for the groups of un-normalised entity means."""
    params = {**DEFAULTS, **(params or {})}
    rows, columns, _ = _training_rows(labelled)
    rows = rows.persist()
    try:
        return materialise(out_of_bag_votes(rows, {**params, "mtry": min(params["mtry"], len(columns))}, bags))
    finally:
        rows.unpersist()


def fit_group_forest(
    labelled: DataFrame, params: dict[str, Any] | None = None, folds: int = 5, parallelism: int = 4
) -> GroupForest:
    """Learn the group from un-normalised entity means; accuracy is that of cross-validation."""
    params = {**DEFAULTS, **(params or {})}
    rows, columns, lambdas = _training_rows(labelled)
    rows = rows.persist()
    try:
        classifier = _classifier({**params, "mtry": min(params["mtry"], len(columns))})
        if folds < 2:
            return GroupForest(classifier.fit(rows), columns, lambdas)
        search = CrossValidator(
            estimator=classifier,
            estimatorParamMaps=ParamGridBuilder().build(),
            evaluator=_evaluator(),
            numFolds=folds,
            seed=params["seed"] or 0,
            parallelism=parallelism,
        ).fit(rows)
        return GroupForest(search.bestModel, columns, lambdas, search.avgMetrics[0])
    finally:
        rows.unpersist()


def grid_search(
    labelled: DataFrame,
    grid: dict[str, Sequence[Any]] | None = None,
    num_trees: int = 500,
    seed: int = 123,
    train_share: float = 0.7,
    parallelism: int = 4,
    bags: int = 0,
) -> list[dict[str, Any]]:
    """Accuracy of every parameter combination on held-out entities, best first.

    With ``bags``, every combination also gets its out-of-bag error over all entities, and the least one comes first.

    ``mtry`` runs from 2 to the number of features unless the grid names it. The default grid is
    small; pass ``FULL_GRID`` for the whole search.
    """
    grid = dict(grid or SMALL_GRID)
    rows, columns, _ = _training_rows(labelled)
    grid.setdefault("mtry", list(range(2, len(columns) + 1)) if grid.get("min_node_size") == FULL_GRID["min_node_size"] else [2])
    rows = rows.persist()
    try:
        classifier = _classifier({**DEFAULTS, "num_trees": num_trees, "seed": seed, "mtry": 2})
        maps = (
            ParamGridBuilder()
            .addGrid(classifier.featureSubsetStrategy, [str(m) for m in grid["mtry"]])
            .addGrid(classifier.minInstancesPerNode, list(grid["min_node_size"]))
            .addGrid(classifier.subsamplingRate, [float(x) for x in grid["sample_fraction"]])
            .addGrid(classifier.maxDepth, list(grid["max_depth"]))
            .build()
        )
        search = TrainValidationSplit(
            estimator=classifier,
            estimatorParamMaps=maps,
            evaluator=_evaluator(),
            trainRatio=train_share,
            seed=seed,
            parallelism=parallelism,
        ).fit(rows)
        tried = [
            {
                "mtry": int(m[classifier.featureSubsetStrategy]),
                "min_node_size": m[classifier.minInstancesPerNode],
                "sample_fraction": m[classifier.subsamplingRate],
                "max_depth": m[classifier.maxDepth],
                "accuracy": accuracy,
            }
            for m, accuracy in zip(maps, search.validationMetrics)
        ]
        for t in tried if bags else []:
            votes = out_of_bag_votes(rows, {**{k: v for k, v in t.items() if k != "accuracy"}, "num_trees": num_trees, "seed": seed}, bags)
            t["oob_error"] = out_of_bag_error(votes).first()["error"]
    finally:
        rows.unpersist()
    # Without a vote the error is unknown, which comes last.
    return sorted(tried, key=lambda t: (t["oob_error"] is None, t["oob_error"] or 0.0) if bags else -t["accuracy"])


def fit_best_forest(labelled: DataFrame, grid: dict[str, Sequence[Any]] | None = None, num_trees: int = 500, seed: int = 123) -> GroupForest:
    """Search the grid, then train with the best parameters."""
    best = grid_search(labelled, grid, num_trees, seed)[0]
    params = {k: best[k] for k in ("mtry", "min_node_size", "sample_fraction", "max_depth")}
    return fit_group_forest(labelled, {**params, "num_trees": num_trees, "seed": seed})


def changed_groups(grouped: DataFrame) -> DataFrame:
    """How often each entity's group changes from one of its bins to the next, most changes first.

    An entity has at most one row per bin, so the number of bins bounds a window's size.
    """
    order = Window.partitionBy("entity").orderBy("bin")
    before = F.lag(GROUP).over(order)
    changed = (F.col(GROUP) != before).cast("long")
    counts = grouped.withColumn("_c", F.coalesce(changed, F.lit(0).cast("long"))).groupBy("entity").agg(F.sum("_c").alias("changed_groups"))
    return counts.orderBy(F.desc("changed_groups"), "entity")


def row_sequence(features: DataFrame) -> DataFrame:
    """Number an entity's rows 0, 1, … in time order."""
    order = Window.partitionBy("entity").orderBy("bin")
    return features.withColumn("sequence", (F.row_number().over(order) - 1).cast("long"))
