"""The analyses a user runs: flagged rows or rankings from events or features, and group drift."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from loginlens.functions.timebin import TimeBin
from loginlens.operators.calendar import resolve_range
from loginlens.operators.detector import Detector, DetectorModel, load_detector
from loginlens.operators.features import FeatureRegistry, extract_features
from loginlens.operators.forest import GroupForest, changed_groups, fit_best_forest, fit_group_forest
from loginlens.operators.grouping import GroupModel, attach_group, fit_groups, labelled_means, spectral_groups, visited_groups
from loginlens.operators.iforest import IsolationForestDetector
from loginlens.operators.knn import KNNDetector
from loginlens.operators.lscp import LSCPDetector
from loginlens.operators.mixture import MixtureEnergyDetector
from loginlens.operators.normalise import MinMax, entity_means, merge_min_max, min_max, min_max_from_table, min_max_table, normalise
from loginlens.operators.prep import clean
from loginlens.operators.rank import flagged, rank, sort_by_score
from loginlens.operators.stats import data_statistics
from loginlens.schema import GROUP
from loginlens.session import stored

DETECTORS: dict[str, type[Detector]] = {
    d.kind: d for d in (KNNDetector, IsolationForestDetector, MixtureEnergyDetector, LSCPDetector)
}


@dataclass
class Options:
    """What to analyse and how; the defaults are the user view, day bins and nearest neighbours."""

    view: str = "user"
    time_bin: TimeBin = TimeBin()
    start: dt.date | str | None = None
    end: dt.date | str | None = None
    span: str = "auto"
    ignore_accounts: tuple[int, int] | None = (0, 10_000)
    method: str = "kNN"
    params: dict[str, Any] = field(default_factory=dict)
    rank: str | None = None
    clusters: int = 13
    spectral: bool = False
    seed: int = 123
    restarts: int = 100
    group_changes: bool = False
    dynamic: bool = False
    registry: FeatureRegistry | None = None

    def __post_init__(self) -> None:
        if self.method not in (*DETECTORS, "RF"):
            raise ValueError(f"method must be one of {[*DETECTORS, 'RF']}")
        if self.rank not in (None, "first", "m", "v"):
            raise ValueError("rank must be first, m or v")
        if self.rank == "v" and self.view != "user":
            raise ValueError("the variance ranking works with the user view only")
        if self.clusters < 2:
            raise ValueError("at least two clusters are needed")


@dataclass
class Models:
    """Everything needed to score new data the same way."""

    groups: GroupModel | None
    bounds: MinMax
    detector: DetectorModel | None = None

    def save(self, path: str) -> None:
        if self.groups is None:
            raise ValueError("spectral groups cannot be stored: they do not apply to new entities")
        self.groups.save(f"{path}/groups")
        min_max_table(SparkSession.active(), self.bounds).write.parquet(f"{path}/min_max")
        if self.detector is not None:
            self.detector.save(f"{path}/detector")

    @classmethod
    def load(cls, path: str, method: str) -> "Models":
        """All artefacts must exist and the detector must be of the wanted method."""
        bounds = min_max_from_table(SparkSession.active().read.parquet(f"{path}/min_max"))
        return cls(GroupModel.load(f"{path}/groups"), bounds, load_detector(f"{path}/detector", method))


def features_of(logons: DataFrame, options: Options) -> DataFrame:
    """Date range on the events as read, then cleaning and feature extraction."""
    start, end = resolve_range(logons, options.span, options.start, options.end)
    features = extract_features(
        clean(logons, options.ignore_accounts), start, end, options.view, options.time_bin, registry=options.registry
    )
    return features


def statistics_of(logons: DataFrame, options: Options) -> dict[str, dict[str, DataFrame]]:
    """Statistics tables before and after cleaning."""
    start, end = resolve_range(logons, options.span, options.start, options.end)
    cleaned = stored(clean(logons, options.ignore_accounts), "clean")
    return {"pre": data_statistics(logons, start, end), "post": data_statistics(cleaned, start, end)}


def _left_out(options: Options, role: str) -> list[str]:
    return options.registry.left_out_of(role) if options.registry else []


def group_features(features: DataFrame, options: Options, models: Models | None = None) -> tuple[DataFrame, Models]:
    """Group entities by mean behaviour, add the group to their rows, scale the features."""
    means = entity_means(features, _left_out(options, "in_means"))
    if models is not None:
        groups = models.groups
        found = groups.assign(means)
    elif options.spectral:
        groups, found = None, spectral_groups(means, options.clusters, seed=options.seed)
    else:
        groups = fit_groups(means, options.clusters, options.seed, options.restarts)
        found = groups.assign(means)
    grouped = attach_group(features, found)
    bounds = min_max(grouped, _left_out(options, "normalise"))
    if models is not None:
        bounds = merge_min_max(models.bounds, bounds)
    return normalise(grouped, bounds), Models(groups, bounds, models.detector if models else None)


def score_features(
    features: DataFrame, options: Options, models: Models | None = None, keep_model: bool = False
) -> tuple[DataFrame, type[Detector], Models]:
    """Scored rows of a feature table; a table without groups is grouped and scaled first.

    A loaded detector scores the rows. Otherwise one is fitted, and returned with ``keep_model``.
    """
    if options.method == "RF":
        raise ValueError("the random forest compares groups; use group_drift")
    detector_class = DETECTORS[options.method]
    if GROUP not in features.columns:
        features, models = group_features(features, options, models)
    if models is not None and models.detector is not None:
        return models.detector.transform(features), detector_class, models
    detector = detector_class(**options.params)
    if models is None or not keep_model:
        return detector.fit_transform(features), detector_class, models or Models(None, {}, None)
    models.detector = detector.fit(features)
    return models.detector.transform(features), detector_class, models


def _feature_table(table: DataFrame, options: Options) -> DataFrame:
    """Given features as they are; extracted ones are written once, since every later step reads them."""
    return table if "number_events" in table.columns else stored(features_of(table, options), "features")


def find_anomalies(
    table: DataFrame, options: Options = Options(), load_from: str | None = None, save_to: str | None = None
) -> DataFrame:
    """Flagged rows, or with ``options.rank`` a ranking, from raw events or from a feature table."""
    features = _feature_table(table, options)
    models = Models.load(load_from, options.method) if load_from else None
    scored, detector, models = score_features(features, options, models, keep_model=save_to is not None)
    if save_to:
        models.save(save_to)
    if options.rank:
        return rank(scored, options.rank, detector.higher_is_worse)
    return sort_by_score(flagged(scored, detector.anomaly_id), detector.higher_is_worse)


def group_drift(
    table: DataFrame, options: Options, load_from: str | None = None, save_to: str | None = None
) -> DataFrame:
    """Per entity the number of groups its bins behave like, or of changes between them."""
    features = _feature_table(table, options)
    if load_from:
        forest = GroupForest.load(f"{load_from}/forest")
    else:
        groups = fit_groups(entity_means(features), options.clusters, options.seed, options.restarts)
        labelled = labelled_means(features, groups)
        forest = fit_best_forest(labelled, **options.params) if options.dynamic else fit_group_forest(labelled, options.params)
        if save_to:
            groups.save(f"{save_to}/groups")
            forest.save(f"{save_to}/forest")
    predicted = forest.predict(features)
    return changed_groups(predicted) if options.group_changes else visited_groups(predicted)
