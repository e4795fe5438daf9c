"""What all detectors share: parameters, key and feature columns, saving and loading."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any, ClassVar

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlens.plans.params import check_params
from loginlens.schema import as_model_value, model_columns

VECTOR = "_features"


class DetectorParams(Params):
    """Parameters every detector has."""

    contamination = Param(Params._dummy(), "contamination", "expected share of anomalies", TypeConverters.toFloat)
    featureCols = Param(Params._dummy(), "featureCols", "columns to look at", TypeConverters.toListString)
    vectorCol = Param(Params._dummy(), "vectorCol", "array column to look at instead", TypeConverters.toString)
    keyCols = Param(Params._dummy(), "keyCols", "columns that name a row", TypeConverters.toListString)

    def value(self, name: str) -> Any:
        """The parameter's value, None when it has none."""
        param = self.getParam(name)
        return self.getOrDefault(param) if self.isDefined(param) else None

    def columns_of(self, df: DataFrame) -> list[str]:
        if self.value("vectorCol"):
            return [self.value("vectorCol")]
        return self.value("featureCols") or model_columns(df)

    def with_vector(self, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """Add the model input as one array of doubles; NULL values are refused."""
        names = list(columns) if columns else self.columns_of(df)
        missing = [c for c in names if c not in df.columns]
        if missing:
            raise ValueError(f"the features differ from the model's: missing {missing}")
        if self.value("vectorCol"):
            return df.withColumn(VECTOR, F.col(names[0]).cast("array<double>"))
        values = [as_model_value(df, c) for c in names]
        checked = [F.when(v.isNull(), F.raise_error(F.lit(f"NULL in feature {c}"))).otherwise(v) for c, v in zip(names, values)]
        return df.withColumn(VECTOR, F.array(*checked))


class Detector(Estimator, DetectorParams):
    """A detector: ``fit`` learns from feature rows, the model adds ``scores`` and ``anomaly``.

    A new detector subclasses this and :class:`DetectorModel`.
    """

    kind: ClassVar[str]
    higher_is_worse: ClassVar[bool] = True
    anomaly_id: ClassVar[int] = 1

    def __init__(self, **values: Any) -> None:
        super().__init__()
        self._setDefault(keyCols=["entity", "bin"], **self.defaults())
        self._set(**{k: v for k, v in values.items() if v is not None})
        check_params(self.kind, {p.name: self.value(p.name) for p in self.params})

    @classmethod
    def defaults(cls) -> dict[str, Any]:
        return {}

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Scores of the rows the model is fitted on."""
        return self.fit(df).transform(df)


class DetectorModel(Model, DetectorParams):
    """A fitted detector."""

    kind: ClassVar[str]
    higher_is_worse: ClassVar[bool] = True
    anomaly_id: ClassVar[int] = 1
    registry: ClassVar[dict[str, type["DetectorModel"]]] = {}

    columns: list[str]

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        DetectorModel.registry[cls.kind] = cls

    def state(self) -> dict[str, Any]:
        """Small values to store as JSON."""
        return {}

    def tables(self) -> dict[str, DataFrame]:
        """Tables to store as Parquet."""
        return {}

    def restore(self, state: dict[str, Any], read: Callable[[str], DataFrame]) -> None:
        """Take over stored values and tables."""
        raise NotImplementedError

    def load_members(self, path: str) -> None:
        """Load models this one is made of."""

    def save(self, path: str) -> None:
        """Write the model to a new folder."""
        spark = SparkSession.active()
        params = {p.name: self.value(p.name) for p in self.params if self.isDefined(p)}
        metadata = {"kind": self.kind, "columns": self.columns, "params": params, "state": self.state()}
        spark.createDataFrame([(json.dumps(metadata),)], "value string").write.text(f"{path}/metadata")
        for name, table in self.tables().items():
            table.write.parquet(f"{path}/{name}")


def load_detector(path: str, kind: str | None = None) -> DetectorModel:
    """Read a saved model; a model of another kind than the wanted one is refused."""
    spark = SparkSession.active()
    metadata = json.loads(spark.read.text(f"{path}/metadata", wholetext=True).first()["value"])
    if kind is not None and metadata["kind"] != kind:
        raise ValueError(f"the model in {path} is {metadata['kind']}, not {kind}")
    cls = DetectorModel.registry.get(metadata["kind"])
    if cls is None:
        raise ValueError(f"no detector is registered as {metadata['kind']}")
    model = cls.__new__(cls)
    super(DetectorModel, model).__init__()
    model._set(**metadata["params"])
    model.columns = metadata["columns"]
    model.restore(metadata["state"], lambda name: spark.read.parquet(f"{path}/{name}"))
    model.load_members(path)
    return model
