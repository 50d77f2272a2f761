"""Fitted objects that can be saved and scored elsewhere, as Spark ML estimators and models.

* :class:`TablePreprocessor` (T5, T6) learns medians, means, deviations, modes and levels and adds a ``features`` vector;
* :class:`ShareRecommender` (M11, M12, M13) learns one stage's recommender and scores customers;
* :class:`NearestNeighbours` (M5) keeps its bounded number of labelled rows and classifies vectors.

All three go into a ``Pipeline``, and their models have ``write().save`` and ``load``: constants are a JSON parameter of the metadata
that Spark writes, tables (the rows of the neighbours) and other models (estimators given as regressors) lie beside it.
``save_run`` and ``load_run`` do the same for a whole comparison, so that a stream or a batch job starts from a folder.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators import knn, prep, recommend as R, recommender as M
from marketlens.operators.features import FIXTURE_REFERENCE_YEAR
from marketlens.operators.linreg import LinearModel
from marketlens.operators.models import PerTargetModel
from marketlens.schema import PRODUCT_COLUMNS, STAGE_FEATURE_SETS


def _lists(names: Sequence[str] | None) -> list[str]:
    return list(names or [])


class _WithState(Params):
    """Fitted constants as one JSON parameter."""

    state = Param(Params._dummy(), "state", "fitted constants as JSON", typeConverter=TypeConverters.toString)

    def _get_state(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    def _with_state(self, state: dict):
        self._set(state=json.dumps(state))
        return self


# ---------------------------------------------------------------------------
# T5 / T6
# ---------------------------------------------------------------------------
class TablePreprocessor(Estimator, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Median, log1p, scale, mode and dummies of the given columns as one vector."""

    numeric = Param(Params._dummy(), "numeric", "columns to impute and scale", typeConverter=TypeConverters.toListString)
    logNumeric = Param(Params._dummy(), "logNumeric", "columns to impute, log1p and scale", typeConverter=TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "columns to fill and expand into levels", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, numeric=None, logNumeric=None, categorical=None, outputCol="features"):
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(numeric=_lists(numeric), logNumeric=_lists(logNumeric), categorical=_lists(categorical), outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> TablePreprocessorModel:
        fitted = prep.fit_preprocessor(dataset, self.getOrDefault(self.numeric), self.getOrDefault(self.categorical), self.getOrDefault(self.logNumeric))
        return TablePreprocessorModel.of(fitted, self.getOutputCol())


class TablePreprocessorModel(Model, HasOutputCol, _WithState, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the vector; all columns stay."""

    @classmethod
    def of(cls, fitted: prep.FittedPreprocessor, output: str = "features") -> TablePreprocessorModel:
        return cls()._with_state(vars(fitted))._set(outputCol=output)

    @property
    def fitted(self) -> prep.FittedPreprocessor:
        return prep.FittedPreprocessor(**self._get_state())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset, keep=[F.col(f"`{c}`") for c in dataset.columns], output=self.getOutputCol())


# ---------------------------------------------------------------------------
# M11 / M12 / M13
# ---------------------------------------------------------------------------
class ShareRecommender(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """One stage's recommender, fitted on prepared customers (training side of the split)."""

    stage = Param(Params._dummy(), "stage", "feature set", typeConverter=TypeConverters.toString)
    regressor = Param(Params._dummy(), "regressor", "name of the regressor", typeConverter=TypeConverters.toString)
    products = Param(Params._dummy(), "products", "target columns", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, stage="Existing-customer", regressor=M.LINEAR, products=None):
        super().__init__()
        self._set(stage=stage, regressor=regressor, products=list(products or PRODUCT_COLUMNS))

    def _fit(self, dataset: DataFrame) -> ShareRecommenderModel:
        stage, products = self.getOrDefault(self.stage), self.getOrDefault(self.products)
        train = M.materialize(M.prepared_targets(dataset, product_cols=products)).filter(~F.col("is_test"))
        model = M.fit_stage_model(train, stage, STAGE_FEATURE_SETS[stage], self.getOrDefault(self.regressor), products)
        return ShareRecommenderModel.of(model, R.fitted_prior(train, products), M.P.mode_category(dataset), products)


class _SubModels(MLWriter):
    """Metadata, and the models of a :class:`PerTargetModel` beside it."""

    def __init__(self, instance: ShareRecommenderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        for i, model in enumerate(self.instance.sub_models.values()):
            model.write().session(self.sparkSession).save(f"{path}/targets/{i}")


class _SubModelsReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ShareRecommenderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        found = self.cls()
        found._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(found, metadata)
        targets = found._get_state().get("targets", {})
        found.sub_models = {t: DefaultParamsReader.loadParamsInstance(f"{path}/targets/{i}", self.sparkSession) for i, t in enumerate(targets)}
        return found


class ShareRecommenderModel(Model, _WithState, MLReadable, MLWritable):
    """Scores customers: shares, relative scores, top product and banner."""

    def __init__(self):
        super().__init__()
        self.sub_models: dict = {}

    @classmethod
    def of(cls, model: M.StageModel, prior: DataFrame, fill_status: str | None, products: Sequence[str] = PRODUCT_COLUMNS) -> ShareRecommenderModel:
        out, linear = cls(), model.linear
        state = {"stage": model.stage, "model_name": model.model_name, "features": model.features, "pre": vars(model.pre), "products": list(products),
                 "prior": prior.first().asDict(), "fill_status": fill_status}
        if isinstance(linear, LinearModel):
            state["linear"] = {"coef": linear.coef.tolist(), "intercept": linear.intercept.tolist(), "targets": linear.targets, "degree2": linear.degree2}
        elif isinstance(linear, PerTargetModel):
            state["targets"] = list(linear.models)
            out.sub_models = dict(linear.models)
        else:
            raise ValueError(f"a model of type {type(linear).__name__} cannot be saved")
        return out._with_state(state)

    def stage_model(self) -> M.StageModel:
        s = self._get_state()
        if "linear" in s:
            p, q = len(s["linear"]["coef"]), len(s["linear"]["intercept"])
            linear = LinearModel(np.array(s["linear"]["coef"]).reshape(p, q), np.array(s["linear"]["intercept"]), s["linear"]["targets"], s["linear"]["degree2"])
        else:
            linear = PerTargetModel(self.sub_models)
        return M.StageModel(s["stage"], s["model_name"], s["features"], prep.FittedPreprocessor(**s["pre"]), linear)

    def as_run(self, spark: SparkSession) -> M.RecommendationRun:
        """What :func:`recommender.score_customers` takes."""
        s = self._get_state()
        prior = spark.createDataFrame([tuple(s["prior"].values())], ", ".join(f"`{c}` double" for c in s["prior"]))
        key = (s["stage"], s["model_name"])
        return M.RecommendationRun(None, key, None, {key: self.stage_model()}, prior, None, s["fill_status"])  # type: ignore[arg-type]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.score(dataset)

    def score(self, customers: DataFrame, prepare: bool = True, reference_year: int = FIXTURE_REFERENCE_YEAR) -> DataFrame:
        return M.score_customers(customers, self.as_run(customers.sparkSession), prepare=prepare, product_cols=self._get_state()["products"],
                                 reference_year=reference_year)

    def write(self) -> _SubModels:
        return _SubModels(self)

    @classmethod
    def read(cls) -> _SubModelsReader:
        return _SubModelsReader(cls)


def save_run(run: M.RecommendationRun, path: str, products: Sequence[str] = PRODUCT_COLUMNS) -> str:
    """A whole comparison: every fitted model, the summary and the baseline; the list of models is written last, so an unfinished folder cannot be loaded."""
    spark = run.prior.sparkSession
    keys = list(run.models)
    for i, key in enumerate(keys):
        ShareRecommenderModel.of(run.models[key], run.prior, run.fill_status, products).write().session(spark).overwrite().save(f"{path}/models/{i}")
    if run.summary is not None:
        run.summary.withColumnsRenamed({c: c.replace(" ", "_") for c in run.summary.columns}).write.mode("overwrite").parquet(f"{path}/summary")
    if run.baseline is not None:
        run.baseline.write.mode("overwrite").parquet(f"{path}/baseline")
    table = [(i, stage, name, (stage, name) == tuple(run.final_key), run.summary is not None, run.baseline is not None) for i, (stage, name) in enumerate(keys)]
    spark.createDataFrame(table, "place int, stage string, model string, final boolean, summary boolean, baseline boolean").coalesce(1) \
        .write.mode("overwrite").json(f"{path}/run")
    return path


def load_run(spark: SparkSession, path: str) -> M.RecommendationRun:
    """The comparison saved at ``path``; its final prediction frame is not kept, customers are scored anew."""
    table = spark.read.schema("place int, stage string, model string, final boolean, summary boolean, baseline boolean").json(f"{path}/run").collect()
    found = {(r["stage"], r["model"]): ShareRecommenderModel.load(f"{path}/models/{r['place']}") for r in table}
    if not found:
        raise ValueError(f"no models in {path}")
    one = next(iter(found.values())).as_run(spark)
    summary = spark.read.parquet(f"{path}/summary") if table[0]["summary"] else None
    if summary is not None:
        summary = summary.withColumnsRenamed({c: c.replace("_", " ") for c in summary.columns})
    baseline = spark.read.parquet(f"{path}/baseline") if table[0]["baseline"] else None
    final = next((r["stage"], r["model"]) for r in table if r["final"])
    return M.RecommendationRun(summary, final, None, {k: m.stage_model() for k, m in found.items()}, one.prior, baseline, one.fill_status)  # type: ignore[arg-type]


# ---------------------------------------------------------------------------
# M5
# ---------------------------------------------------------------------------
class NearestNeighbours(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps at most ``maxRows`` labelled rows, in hash order of ``ID``."""

    k = Param(Params._dummy(), "k", "neighbours asked", typeConverter=TypeConverters.toInt)
    maxRows = Param(Params._dummy(), "maxRows", "labelled rows kept", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, k=15, maxRows=knn.MAX_TRAIN_ROWS, featuresCol="features", labelCol="label"):
        super().__init__()
        self._set(k=k, maxRows=maxRows, featuresCol=featuresCol, labelCol=labelCol)

    def _fit(self, dataset: DataFrame) -> NearestNeighboursModel:
        rows = dataset.select("ID", vector_to_array(self.getFeaturesCol()).alias("vec"), F.col(self.getLabelCol()).cast("double").alias("label"))
        out = NearestNeighboursModel()._set(k=self.getOrDefault(self.k), maxRows=self.getOrDefault(self.maxRows), featuresCol=self.getFeaturesCol())
        out.rows = knn.fitted_rows(rows, max_train_rows=self.getOrDefault(self.maxRows))
        return out


class _RowsWriter(MLWriter):
    def __init__(self, instance: NearestNeighboursModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        self.instance.rows.write.parquet(f"{path}/rows")
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)


class _RowsReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> NearestNeighboursModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        found = self.cls()
        found._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(found, metadata)
        found.rows = self.sparkSession.read.parquet(f"{path}/rows")
        return found


class NearestNeighboursModel(Model, HasFeaturesCol, MLReadable, MLWritable):
    """``ID, score, prediction`` of the rows to classify."""

    k, maxRows = NearestNeighbours.k, NearestNeighbours.maxRows

    def __init__(self):
        super().__init__()
        self.rows: DataFrame | None = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        test = dataset.select("ID", vector_to_array(self.getFeaturesCol()).alias("vec"))
        return knn.knn_classify(self.rows, test, self.getOrDefault(self.k), max_train_rows=self.getOrDefault(self.maxRows))

    def write(self) -> _RowsWriter:
        return _RowsWriter(self)

    @classmethod
    def read(cls) -> _RowsReader:
        return _RowsReader(cls)
