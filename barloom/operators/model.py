"""Probability models: an interface, a registry, boosted trees, two-stage training."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splits import early_stopping


@dataclass(frozen=True)
class DataInfo:
    """What a model is told of its data: number and names of features, target and horizon."""

    n_features: int | None = None
    feature_names: tuple[str, ...] = ()
    target_name: str = "target_up"
    horizon_minutes: int | None = 30

    def __post_init__(self):
        for name in ("n_features", "horizon_minutes"):
            if getattr(self, name) is not None and getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.n_features is not None and self.feature_names and len(self.feature_names) != self.n_features:
            raise ValueError(f"{len(self.feature_names)} names for {self.n_features} features")

    def as_dict(self) -> dict:
        return asdict(self)


class ProbabilityModel:
    """Learns P(up) from rows with ``target_up``; ``validation`` rows may stop the training."""

    def fit(self, train: DataFrame, names: list[str], validation: DataFrame | None = None) -> ProbabilityModel:
        raise NotImplementedError

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``predicted_probability_up``."""
        raise NotImplementedError

    def importance(self) -> list[tuple[str, float]]:
        raise NotImplementedError


@dataclass
class BoostedTrees(ProbabilityModel):
    """Spark's boosted trees. They stand for leaf-wise boosting by interface, not by equal numbers."""

    trees: int = 50
    depth: int = 5
    step: float = 0.1
    sample: float = 0.8
    seed: int = 2026
    names: list[str] = field(default_factory=list)
    model: PipelineModel | None = None
    best: int | None = None

    def fit(self, train, names, validation=None):
        self.names = list(names)
        rows = train.withColumn("__check", F.lit(False))
        if validation is not None:
            rows = rows.unionByName(validation.withColumn("__check", F.lit(True)))
        vectors = VectorAssembler(inputCols=self.names, outputCol="__x")
        trees = GBTClassifier(
            featuresCol="__x", labelCol="target_up", maxIter=self.trees, maxDepth=self.depth, stepSize=self.step, subsamplingRate=self.sample, seed=self.seed,
        ).setProbabilityCol("__p").setRawPredictionCol("__raw").setPredictionCol("__prediction")
        if validation is not None:
            trees = trees.setValidationIndicatorCol("__check")
        data = vectors.transform(rows.withColumn("target_up", F.col("target_up").cast("double")))
        fitted = trees.fit(data)
        self.best, self.model = fitted.getNumTrees, PipelineModel([vectors, fitted])
        return self

    def predict(self, rows):
        out = self.model.transform(rows)
        kept = [c for c in rows.columns]
        return out.select(*kept, F.element_at(vector_to_array("__p"), 2).alias("predicted_probability_up"))

    def importance(self):
        gains = self.model.stages[-1].featureImportances.toArray()
        return sorted(zip(self.names, map(float, gains), strict=True), key=lambda x: (-x[1], x[0]))


_registry: dict[str, Callable[..., ProbabilityModel]] = {"boosted_trees": BoostedTrees}


def register(name: str, make: Callable[..., ProbabilityModel]) -> None:
    name = name.strip()
    if not name or name in _registry:
        raise ValueError(f"a new, non-empty name is needed, not {name!r}")
    _registry[name] = make


def make_model(name: str, **params) -> ProbabilityModel:
    if name.strip() not in _registry:
        raise ValueError(f"unknown model: {name!r}")
    return _registry[name.strip()](**params)


def check_targets(rows: DataFrame) -> None:
    bad = rows.agg(F.count_if(F.col("target_up").isNotNull() & ~F.col("target_up").isin(0, 1)).alias("n")).first().n
    if bad:
        raise ValueError(f"{bad} targets are neither 0 nor 1")


def train_two_stages(train: DataFrame, names: list[str], make: Callable[..., ProbabilityModel], key: str = "symbol", **params) -> ProbabilityModel:
    """First find the number of trees on the later part of training, then fit all of it with that number."""
    check_targets(train)
    parts = early_stopping(train, key=key)
    first = make(**params).fit(parts.filter("part = 'train_fit'").drop("part"), names, parts.filter("part = 'train_es'").drop("part"))
    return make(**params | {"trees": max(1, first.best)}).fit(train, names)
