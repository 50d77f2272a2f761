"""The recommender comparison and scoring.

Protocol of the published workflow, on Spark:

* valid customers = prepared rows with positive spend; targets = six shares;
* 80/20 hash split, product prior from the train shares, test actuals scaled
  by the same prior, baseline = most frequent train top product;
* for each stage feature set x model (OLS, OLS on degree-2 terms): 5-fold CV
  R2 on raw predictions over all valid rows; holdout fit, predictions clipped
  and row-normalised, R2 / MAE / RMSE, relative scores, top product, match
  rate and lift over the baseline;
* summary sorted by (match rate, test R2) descending; the first row is the
  final model, whose prediction frame is the recommendation output.

All fits of all folds, stages and least-squares models come from one scan of sums of products for each cell of rows (fold and side of the
split; ``operators.fold_moments``), after the counting passes that give the medians of every training subset; the fold errors follow from
the same sums.  The holdout predictions of all models are scored by one job.  Models are given by name or as a mapping
(``operators.models``); those that are not sums of products (any Spark ML estimator) are fitted for each split.  The prepared frame is checkpointed
once, so everything reads it instead of re-deriving the customer table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators import features as P, fold_moments as FM, prep, recommend as R, split as S
from marketlens.functions.rowexpr import safe_ratio, top1_product
from marketlens.operators.linreg import LinearModel, fit_least_squares
from marketlens.operators.models import LeastSquares, as_mapping, as_regressor, on_moments
from marketlens.schema import PRODUCT_COLUMNS, REGRESSOR_NAMES, STAGE_FEATURE_SETS
from marketlens.session import materialize

LINEAR, POLY = REGRESSOR_NAMES
#: Regressors that can be asked for by name.
REGRESSORS = {LINEAR: LeastSquares(), POLY: LeastSquares(degree2=True)}


@dataclass
class StageModel:
    stage: str
    model_name: str
    features: list[str]
    pre: prep.FittedPreprocessor
    linear: LinearModel

    def _design(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Preprocessed features as one array column (degree-2 terms are formed in the tasks)."""
        return df.select(*keep, self.pre.output_array().alias("f"))

    def predict_raw(self, df: DataFrame, keep: Sequence[str] = ("ID",)) -> DataFrame:
        return self.linear.predict(self._design(df, keep), "f", keep)


def fit_stage_model(train: DataFrame, stage: str, features: Sequence[str], model_name: str, product_cols: Sequence[str] = PRODUCT_COLUMNS,
                    pre: prep.FittedPreprocessor | None = None, model=None) -> StageModel:
    """One model on one training table; ``model`` is that of ``REGRESSORS`` unless given."""
    pre, model = pre or prep.fit_stage(train, features), as_regressor(model or as_mapping([model_name], REGRESSORS)[model_name])
    sm = StageModel(stage, model_name, list(features), pre, None)  # type: ignore[arg-type]
    design = sm._design(train, ["ID", *product_cols])
    if isinstance(model, LeastSquares) and not model.ridge:
        sm.linear = fit_least_squares(design, "f", list(product_cols), dim=pre.size, degree2=model.degree2)
    elif on_moments(model):
        terms = FM.table_terms(train, pre.numeric, pre.categorical, pre.log_numeric, model.degree2)
        rows = FM.total(FM.cell_moments(train, terms, product_cols, F.lit(0)), {0})
        sm.linear = model.solve(FM.normal_equations(rows, FM.design(terms, pre, model.degree2)), list(product_cols))
    else:
        sm.linear = model.fit(design, "f", list(product_cols))
    return sm


def _column_roles(features: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """Numeric, categorical and log columns of a feature set, as :func:`prep.fit_stage` picks them."""
    return tuple([c for c in candidates if c in features]
                 for candidates in (prep.STANDARD_NUMERIC_CANDIDATES, prep.CATEGORICAL_CANDIDATES, prep.LOG_NUMERIC_CANDIDATES))  # type: ignore[return-value]


class FoldFits:
    """Fits of every stage, model and training subset from sums of products.

    ``data`` (stored) has the features, the targets, ``fold`` and ``is_test``.  All stages share one scan; if their columns together have too many
    products, each stage has its own.
    """

    def __init__(self, data: DataFrame, feature_sets: Mapping[str, Sequence[str]], product_cols: Sequence[str], n_folds: int, degree2: bool):
        self.product_cols, self.sets = list(product_cols), feature_sets
        self.cells = {2 * f + t for f in range(n_folds) for t in (0, 1)}
        self.train = {f: {c for c in self.cells if c // 2 != f} for f in range(n_folds)} | {"holdout": {c for c in self.cells if c % 2 == 0}}
        cell = F.col("fold") * 2 + F.col("is_test").cast("int")
        together = [c for s in feature_sets.values() for c in s]
        num, cat, log = _column_roles(together)
        try:
            shared = FM.table_terms(data, num, cat, log, degree2)
            self.terms = dict.fromkeys(feature_sets, shared)
        except ValueError:
            self.terms = {}
            for s, features in feature_sets.items():
                n, c, lg = _column_roles(features)
                self.terms[s] = FM.table_terms(data, n, c, lg, degree2)
        sums = {id(t): FM.cell_moments(data, t, self.product_cols, cell) for t in {id(t): t for t in self.terms.values()}.values()}
        self.sums = {s: sums[id(t)] for s, t in self.terms.items()}
        ends = {c: e for t in self.terms.values() for c, e in t.ends.items()}
        self.medians = FM.group_medians(data, log + num, self.train, cell, ends=ends)

    def preprocessor(self, stage: str, subset) -> prep.FittedPreprocessor:
        num, cat, log = _column_roles(self.sets[stage])
        return FM.fitted_preprocessor(self.terms[stage], FM.total(self.sums[stage], self.train[subset]), self.medians[subset], num, cat, log)

    def model(self, stage: str, name: str, model, subset) -> tuple[StageModel, np.ndarray]:
        """The fitted stage model, and its features in monomials."""
        pre = self.preprocessor(stage, subset)
        design = FM.design(self.terms[stage], pre, model.degree2)
        linear = model.solve(FM.normal_equations(FM.total(self.sums[stage], self.train[subset]), design), self.product_cols)
        return StageModel(stage, name, list(self.sets[stage]), pre, linear), design

    def fold_r2(self, stage: str, name: str, model, fold: int) -> float:
        """R2 of raw predictions on the fold that was left out, averaged over targets."""
        fitted, design = self.model(stage, name, model, fold)
        out = FM.total(self.sums[stage], self.cells - self.train[fold])
        sse, sst = FM.errors(out, design, fitted.linear.coef, fitted.linear.intercept)
        flat = sst <= 1e-12 * np.maximum(out.yy, 1e-300)
        return float(np.where(flat, (sse <= 1e-12 * out.yy).astype(float), 1 - sse / np.where(flat, 1.0, sst)).mean())


def prepared_targets(prepared: DataFrame, feature_sets: Mapping[str, Sequence[str]] = STAGE_FEATURE_SETS,
                     product_cols: Sequence[str] = PRODUCT_COLUMNS, test_size: float = 0.2,
                     n_folds: int = 5) -> DataFrame:
    """ID, stage feature columns, six shares, ``is_test`` and ``fold`` (J3: valid rows only)."""
    cols = P.stage_feature_columns(feature_sets)
    shares = P.spending_share_target(prepared, product_cols, keep=cols)
    return S.split_and_folds(shares, test_size, n_folds)


def _scores(row, product_cols: Sequence[str]) -> tuple[float, float, float]:
    """R2, MAE and RMSE from the sums."""
    n, k = row["n"], len(product_cols)
    if not n:
        return 0.0, 0.0, 0.0
    r2s = []
    for c in product_cols:
        sst, sse = row["var_" + c] * n, row["sse_" + c]
        r2s.append((1.0 if sse == 0 else 0.0) if sst <= 0 else 1.0 - sse / sst)
    return (sum(r2s) / k, sum(row["sae_" + c] for c in product_cols) / (n * k),
            (sum(row["sse_" + c] for c in product_cols) / (n * k)) ** 0.5)


@dataclass
class RecommendationRun:
    summary: DataFrame
    final_key: tuple[str, str]
    final_predictions: DataFrame
    models: dict
    prior: DataFrame
    baseline: DataFrame
    fill_status: str | None = None


def compare_recommenders(prepared: DataFrame, feature_sets: Mapping[str, Sequence[str]] = STAGE_FEATURE_SETS,
                         models: Sequence[str] | Mapping[str, object] = REGRESSOR_NAMES, product_cols: Sequence[str] = PRODUCT_COLUMNS,
                         n_folds: int = 5, parallelism: int = 8) -> RecommendationRun:
    """E7 (+E9): all stage x model combinations, summary, final model and its prediction frame.

    ``models`` names entries of ``REGRESSORS`` or maps names to models (see ``operators.models``).
    """
    pc, chosen = list(product_cols), {name: as_regressor(m) for name, m in as_mapping(models, REGRESSORS).items()}
    data = materialize(prepared_targets(prepared, feature_sets, pc, n_folds=n_folds))
    train, test = data.filter(~F.col("is_test")), data.filter(F.col("is_test"))
    prior = R.fitted_prior(train, pc)
    actual_rel = R.with_top1(R.relative_preference(data.select("ID", "is_test", *pc), prior, pc), "Actual_Product")
    baseline = R.baseline_product(actual_rel.filter(~F.col("is_test")))
    test_actual = actual_rel.filter("is_test").select("ID", "Actual_Product")
    base_rate = R.match_rate(test_actual.crossJoin(F.broadcast(baseline)), "Actual_Product",
                             "baseline_product").first()[0]
    combos = [(s, m) for s in feature_sets for m in chosen]
    spark = prepared.sparkSession
    actual = ["a_" + c for c in pc]

    def with_actual(rows: DataFrame) -> DataFrame:
        """True shares under their own names, so that they travel with the predictions and no join is needed."""
        return rows.select("*", *[F.col(c).alias("a_" + c) for c in pc])

    quick = {name: m for name, m in chosen.items() if on_moments(m)}
    slow = {name: m for name, m in chosen.items() if name not in quick}
    fits = FoldFits(data, feature_sets, pc, n_folds, any(m.degree2 for m in quick.values()))
    cv = {(s, name, f): fits.fold_r2(s, name, m, f) for s in feature_sets for name, m in quick.items() for f in range(n_folds)}
    fitted = {(s, name): fits.model(s, name, m, "holdout")[0] for s in feature_sets for name, m in quick.items()}

    def slow_task(t):
        stage, name, subset = t
        tr = train if subset == "holdout" else data.filter(F.col("fold") != subset)
        sm = fit_stage_model(tr, stage, feature_sets[stage], name, pc, fits.preprocessor(stage, subset), slow[name])
        if subset == "holdout":
            return t, sm
        pred = sm.predict_raw(with_actual(data.filter(F.col("fold") == subset)), ["ID", *actual]).withColumnsRenamed({c: "p_" + c for c in pc})
        return t, _scores(pred.agg(*R.error_sums(pc)).first(), pc)[0]

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        for (stage, name, subset), found in pool.map(slow_task, [(s, n, f) for s in feature_sets for n in slow for f in [*range(n_folds), "holdout"]]):
            if subset == "holdout":
                fitted[stage, name] = found
            else:
                cv[stage, name, subset] = found

    frames = {}
    for (stage, name), sm in fitted.items():
        norm = R.normalize_shares(sm.predict_raw(with_actual(test), ["ID", *actual]), pc)
        both = norm.withColumnsRenamed({**{"a_" + c: "ActualRatio_" + c for c in pc}, **{c: "PredictedRatio_" + c for c in pc}})
        frames[stage, name] = R.scored_frame(both, prior, pc)
    sums = [*R.error_sums(pc, "ActualRatio_", "PredictedRatio_"), F.avg(F.col("Recommendation_Match").cast("double")).alias("match")]
    told = None
    for i, (stage, name) in enumerate(combos):  # one job scores all
        one = frames[stage, name].agg(*sums).withColumn("combo", F.lit(i))
        told = one if told is None else told.unionByName(one)
    scored = {combos[r["combo"]]: r for r in told.collect()}

    rows = []
    for stage, name in combos:
        folds = [cv[(stage, name, f)] for f in range(n_folds)]
        mean = sum(folds) / n_folds
        std = (sum((v - mean) ** 2 for v in folds) / n_folds) ** 0.5
        r2, mae, rmse = _scores(scored[stage, name], pc)
        match = scored[stage, name]["match"]
        rows.append((stage, name, len(feature_sets[stage]), ", ".join(feature_sets[stage]), mean, std, r2, mae,
                     rmse, match, base_rate, match - base_rate))
    summary = spark.createDataFrame(rows, "`Business Model` string, `Regression Model` string, "
                                    "`Feature Count` int, Features string, `CV R2 Mean` double, `CV R2 Std` double, "
                                    "`Test R2` double, `Test MAE` double, `Test RMSE` double, "
                                    "`Recommendation Match Rate` double, `Baseline Match Rate` double, "
                                    "`Lift vs Baseline` double")
    best = sorted(rows, key=lambda r: (-r[9], -r[6], r[0], r[1]))[0]
    key = (best[0], best[1])
    return RecommendationRun(summary, key, frames[key], fitted, prior, baseline, P.mode_category(prepared))


def score_customers(customers: DataFrame, run: RecommendationRun, key: tuple[str, str] | None = None,
                    prepare: bool = True, product_cols: Sequence[str] = PRODUCT_COLUMNS,
                    reference_year: int = P.FIXTURE_REFERENCE_YEAR) -> DataFrame:
    """Predicted shares, relative scores, top product and banner for new customers.

    Narrow: the model runs once a row, then one projection with the one-row prior; no exchange.  A missing
    marital status gets the value fitted with the model.
    """
    pc = list(product_cols)
    sm: StageModel = run.models[key or run.final_key]
    rows = P.prepare_regression_frame(customers, reference_year, fill_status=run.fill_status) if prepare else customers
    norm = R.normalize_shares(sm.predict_raw(rows, ["ID"]), pc).crossJoin(F.broadcast(run.prior))
    out = norm.select("ID", *[F.col(c).alias("PredictedRatio_" + c) for c in pc],
                      *[safe_ratio(F.col(c), F.col(R.PRIOR_PREFIX + c)).alias("RecommendationScore_" + c) for c in pc])
    rs = ["RecommendationScore_" + c for c in pc]
    return R.add_banner(out.withColumn("Recommended_Product", top1_product(rs, pc)), rs, pc)


def spending_regression(prepared: DataFrame, features: Sequence[str] = ("Income", "Age", "Kidhome", "Teenhome"),
                        target: str = "TotalSpending", test_size: float = 0.2) -> DataFrame:
    """TotalSpending from income, age and children; linear vs degree-2, holdout metrics."""
    spark: SparkSession = prepared.sparkSession
    from marketlens.functions.rowexpr import row_sum_skip_nulls
    d = prepared.withColumn(target, row_sum_skip_nulls(PRODUCT_COLUMNS).cast("double"))
    d = materialize(S.split_flag(d.select("ID", *features, target), test_size))
    train, test = d.filter(~F.col("is_test")), d.filter("is_test")
    pre = prep.fit_preprocessor(train, numeric=list(features))
    rows = []
    for name in REGRESSOR_NAMES:
        sm = StageModel("spending", name, list(features), pre, None)  # type: ignore[arg-type]
        sm.linear = fit_least_squares(sm._design(train, ["ID", target]), "f", [target], dim=pre.size,
                                      degree2=name == POLY)
        pred = sm.predict_raw(test.withColumn("a_" + target, F.col(target)), ["ID", "a_" + target]).withColumnRenamed(target, "p_" + target)
        rows.append((name, *map(float, _scores(pred.agg(*R.error_sums([target])).first(), [target]))))
    return spark.createDataFrame(rows, "model string, r2 double, mae double, rmse double")
