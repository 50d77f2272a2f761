"""Models that the comparisons can be given by name (section 2.14: pluggable models).

A regressor of the recommender comparison is one of

* a model on sums of products (``degree2`` and ``solve(equations, targets)``), such as :class:`LeastSquares`: all its folds are fitted from
  one scan (:mod:`marketlens.operators.fold_moments`);
* any Spark ML ``Estimator`` with ``featuresCol``, ``labelCol`` and ``predictionCol``: fitted for each target and split on the preprocessed features;
* anything with ``fit(rows, features, targets)`` that returns an object with ``predict(rows, features, keep)``.

A classifier of the response comparison is a Spark ML ``Estimator`` (with a ``probability`` or ``rawPrediction`` of two classes, or a
``prediction`` alone), or a function ``(train, test, label) -> ID, label, prediction, score``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.operators.fold_moments import NormalEquations
from marketlens.operators.linreg import LinearModel, min_norm


@dataclass(frozen=True)
class LeastSquares:
    """Least squares of all targets at once; ``ridge`` adds ``ridge * |coefficients|^2`` (the intercept is free)."""

    degree2: bool = False
    ridge: float = 0.0

    def solve(self, equations: NormalEquations, targets: Sequence[str]) -> LinearModel:
        if self.ridge:
            coef = np.linalg.solve(equations.sxx + self.ridge * np.eye(len(equations.sxx)), equations.sxy)
        else:
            coef = min_norm(equations.sxx, equations.sxy)
        return LinearModel(coef, equations.mean_y - equations.mean_x @ coef, list(targets), self.degree2)


@dataclass
class PerTarget:
    """A Spark ML estimator fitted once for each target."""

    estimator: Estimator

    def fit(self, rows: DataFrame, features: str, targets: Sequence[str]) -> PerTargetModel:
        vectors = rows.withColumn("_vector", array_to_vector(features)).persist()
        e = self.estimator
        models = {t: e.copy({e.getParam("featuresCol"): "_vector", e.getParam("labelCol"): t, e.getParam("predictionCol"): "_p_" + t}).fit(vectors) for t in targets}
        vectors.unpersist()
        return PerTargetModel(models)


@dataclass
class PerTargetModel:
    models: dict

    def predict(self, df: DataFrame, features: str = "f", keep: Sequence[str] = ("ID",)) -> DataFrame:
        out = df.select(*keep, array_to_vector(features).alias("_vector"))
        for model in self.models.values():
            out = model.transform(out)
        return out.select(*keep, *[F.col("_p_" + t).alias(t) for t in self.models])


def as_regressor(model):
    return PerTarget(model) if isinstance(model, Estimator) else model


def on_moments(model) -> bool:
    return hasattr(model, "solve")


def as_mapping(models, known: Mapping[str, object]) -> dict:
    """Names of ``known`` models, or a mapping of names to models."""
    if isinstance(models, Mapping):
        return dict(models)
    missing = [m for m in models if m not in known]
    if missing:
        raise ValueError(f"no model is registered under {missing}")
    return {m: known[m] for m in models}


def as_classifier(model) -> Callable[[DataFrame, DataFrame, str], DataFrame]:
    """``(train, test, label) -> ID, label, prediction, score`` of an estimator or function."""
    if not isinstance(model, Estimator):
        return model

    def fit_predict(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
        e = model
        out = e.copy({e.getParam("featuresCol"): "features", e.getParam("labelCol"): label}).fit(train).transform(test)
        score = next((vector_to_array(c)[1] for c in ("probability", "rawPrediction") if c in out.columns), F.col("prediction"))
        return out.select("ID", label, F.col("prediction").cast("int").alias("prediction"), score.cast("double").alias("score"))
    return fit_predict
