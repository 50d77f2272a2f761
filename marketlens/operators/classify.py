"""Campaign-response classifiers (M1-M6), metrics (E1-E4) and the comparison.

Every model writes the same *prediction table* ``(model, fold, ID, label,
prediction, score)``; all metrics for all models and folds then come from
one grouped aggregate (E1) and one distributed exact AUC (E2).  The holdout
uses ``fold = -1``.

* M1 majority: train mode of the label (ties -> 0), constant score.
* M2 / M3 logistic: Newton steps on the published objective (C = 1: log losses plus half the squared coefficients, intercept free), all
  folds and weightings in the same scans (``operators.newton``).
* M6 tree: exact CART (depth 5, >= 20 rows per leaf, gini, balanced weights), all folds level by level (``operators.cart``).
* M5 k-NN: 15 nearest among all training rows (``operators.knn``).
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.ranking import sum_before
from marketlens.functions.rowexpr import quoted, safe_ratio, text
from marketlens.operators import cart, fold_moments as FM, knn, newton, prep
from marketlens.operators.models import as_classifier, as_mapping
from marketlens.schema import CLASSIFIER_NAMES, numeric_and_categorical
from marketlens.session import materialize

LABEL = "label"


# ---------------------------------------------------------------------------
# M4 class weights
# ---------------------------------------------------------------------------
def class_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """M4: ``n / (n_classes * n_c)`` per class of the training rows (one row per class)."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = counts.agg(F.sum("n_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return counts.crossJoin(F.broadcast(tot)).select(
        label, "n_c", (F.col("_n") / (F.col("_k") * F.col("n_c"))).alias("weight"))


def with_weights(df: DataFrame, weights: DataFrame, label: str = LABEL) -> DataFrame:
    return df.join(F.broadcast(weights.select(label, "weight")), label, "left") \
        .withColumn("weight", F.coalesce("weight", F.lit(1.0)))


# ---------------------------------------------------------------------------
# model fits -> prediction rows (ID, label, prediction, score)
# ---------------------------------------------------------------------------
def predict_majority(train: DataFrame, test: DataFrame, label: str = LABEL) -> DataFrame:
    mode = train.agg(F.mode(label, True).alias("_m"))
    return test.crossJoin(F.broadcast(mode)).select(
        "ID", label, F.col("_m").cast("int").alias("prediction"), F.col("_m").cast("double").alias("score"))


def _balanced(n0: float, n1: float) -> tuple[float, float]:
    """Weights of both classes; a class without rows has none."""
    k = (n0 > 0) + (n1 > 0)
    return tuple((n0 + n1) / (k * n) if n else 0.0 for n in (n0, n1))  # type: ignore[return-value]


def _stored(train: DataFrame, label: str) -> tuple[DataFrame, int, tuple[float, float]]:
    """Rows of one training table as the fits read them, number of features, balanced weights."""
    rows = materialize(train.select(F.lit(0).cast("long").alias("cell"), vector_to_array("features").alias("x"), F.col(label).cast("int").alias("y")))
    found = rows.agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"), F.max(F.size("x")).alias("p")).first()
    return rows, found["p"] or 0, _balanced(found["n0"], found["n1"])


def fit_logistic(train: DataFrame, balanced: bool, label: str = LABEL) -> newton.LogisticModel:
    """M2 / M3: minimises the (weighted) sum of log losses + |w|^2 / 2, intercept free."""
    rows, p, weights = _stored(train, label)
    fit = newton.Fit({0}, weights if balanced else (1.0, 1.0), np.concatenate([np.zeros((1, p)), np.eye(p)]))
    return newton.fit_many(rows.withColumnRenamed("x", "z"), {0: fit})[0]


def predict_logistic(train: DataFrame, test: DataFrame, balanced: bool, label: str = LABEL) -> DataFrame:
    return fit_logistic(train, balanced, label).transform(test, label)


def fit_tree(train: DataFrame, label: str = LABEL) -> cart.Tree:
    """M6 on a ``features`` vector."""
    rows, p, weights = _stored(train, label)
    return cart.grow(rows, {0: cart.Tree({0}, weights, np.zeros(p))})[0]


def predict_tree(train: DataFrame, test: DataFrame, label: str = LABEL) -> DataFrame:
    return fit_tree(train, label).transform(test, label, vector_to_array("features"))


def predict_knn(train: DataFrame, test: DataFrame, k: int = 15, label: str = LABEL, max_train_rows: int | None = None) -> DataFrame:
    """M5 by all rows of ``train``, or by at most ``max_train_rows`` of them."""
    tr = train.select("ID", vector_to_array("features").alias("vec"), label)
    te = test.select("ID", vector_to_array("features").alias("vec"), label)
    return knn.knn_classify(tr, te, k=k, vec="vec", label=label, keep=(label,), max_train_rows=max_train_rows).select("ID", label, "prediction", "score")


def fit_predict(name: str, train: DataFrame, test: DataFrame, label: str = LABEL) -> DataFrame:
    if name == "dummy_most_frequent":
        return predict_majority(train, test, label)
    if name == "logistic_regression":
        return predict_logistic(train, test, False, label)
    if name == "logistic_regression_balanced":
        return predict_logistic(train, test, True, label)
    if name == "knn_k15":
        return predict_knn(train, test, 15, label)
    if name == "decision_tree_balanced":
        return predict_tree(train, test, label)
    raise ValueError(f"unknown model {name}")


# ---------------------------------------------------------------------------
# E1 / E2 / E3 / E4 on a prediction table
# ---------------------------------------------------------------------------
def binary_metrics(pred: DataFrame, group: Sequence[str] = ("model", "fold"), label: str = LABEL) -> DataFrame:
    """Accuracy, precision, recall, F1 (zero division -> 0) per group, one aggregate."""
    y, p = F.col(label), F.col("prediction")
    c = pred.groupBy(*group).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    return metrics_from_counts(c, group)


def metrics_from_counts(c: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    precision = safe_ratio(tp, tp + fp)
    recall = safe_ratio(tp, tp + fn)
    return c.select(*group, "tp", "fp", "fn", "tn",
                    safe_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    precision.alias("precision"), recall.alias("recall"),
                    safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc_auc(pred: DataFrame, group: Sequence[str] = ("model", "fold"), label: str = LABEL) -> DataFrame:
    """Exact ROC AUC with ties averaged (Mann-Whitney), per group.

    Scores are first reduced to distinct values with positive / negative
    counts; the count of negatives below each score is a distributed running
    sum.  AUC = sum over scores of pos * (neg_below + neg / 2) / (P * N).
    """
    group = list(group)
    y = F.col(label)
    d = pred.groupBy(*group, "score").agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    c = sum_before(d, group, "score", ["neg"])
    contrib = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    agg = c.groupBy(*group).agg(F.sum(contrib).alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return agg.select(*group, F.try_divide(F.col("_u"), F.col("_p") * F.col("_n")).alias("roc_auc"))


def confusion_matrix(pred: DataFrame, group: Sequence[str] = ("model",), label: str = LABEL) -> DataFrame:
    """Rows actual_0 / actual_1, columns pred_0 / pred_1, all cells present."""
    group = list(group)
    c = pred.groupBy(*group, F.col(label).alias("_y")).agg(
        F.count_if(F.col("prediction") == 0).alias("pred_0"), F.count_if(F.col("prediction") == 1).alias("pred_1"))
    keys = pred.select(*group).distinct() if group else None
    classes = pred.sparkSession.range(2).select(F.col("id").cast("int").alias("_y"))
    grid = keys.crossJoin(F.broadcast(classes)) if keys is not None else classes
    out = grid.join(c, [*group, "_y"], "left")
    return out.select(*group, F.concat(F.lit("actual_"), F.col("_y").cast("string")).alias("actual"),
                      F.coalesce("pred_0", F.lit(0).cast("bigint")).alias("pred_0"),
                      F.coalesce("pred_1", F.lit(0).cast("bigint")).alias("pred_1"))


def classification_report(pred: DataFrame, group: Sequence[str] = ("model",), label: str = LABEL,
                          names: Sequence[str] = ("No Response", "Response")) -> DataFrame:
    """Per class P/R/F1/support, accuracy, macro and support-weighted averages (long form)."""
    group = list(group)
    m = binary_metrics(pred, group, label)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    # class 1 uses (tp, fp, fn); class 0 swaps roles: tp0 = tn, fp0 = fn, fn0 = fp
    p1, r1 = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    f1_1 = safe_ratio(2 * tp, 2 * tp + fp + fn)
    p0, r0 = safe_ratio(tn, tn + fn), safe_ratio(tn, tn + fp)
    f1_0 = safe_ratio(2 * tn, 2 * tn + fn + fp)
    s0, s1 = tn + fp, tp + fn
    acc = safe_ratio(tp + tn, n)
    rows = F.array(
        F.struct(F.lit(names[0]).alias("label"), p0.alias("precision"), r0.alias("recall"), f1_0.alias("f1_score"),
                 s0.alias("support")),
        F.struct(F.lit(names[1]).alias("label"), p1.alias("precision"), r1.alias("recall"), f1_1.alias("f1_score"),
                 s1.alias("support")),
        F.struct(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"),
                 acc.alias("f1_score"), n.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), ((p0 + p1) / 2).alias("precision"),
                 ((r0 + r1) / 2).alias("recall"), ((f1_0 + f1_1) / 2).alias("f1_score"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), safe_ratio(p0 * s0 + p1 * s1, n).alias("precision"),
                 safe_ratio(r0 * s0 + r1 * s1, n).alias("recall"),
                 safe_ratio(f1_0 * s0 + f1_1 * s1, n).alias("f1_score"), n.alias("support")))
    return m.select(*group, F.inline(rows))


# ---------------------------------------------------------------------------
# Cross validation + holdout for all models
# ---------------------------------------------------------------------------
class SplitFits:
    """What all classifiers of all training subsets share: terms, medians and sums from three or four scans.

    ``data`` (stored) carries the features, ``label``, ``is_test`` and ``fold``.  Subset -1 is the training side of the holdout, ``f`` all rows but fold ``f``;
    ``folds`` names those to fit, all unless given.
    """

    def __init__(self, data: DataFrame, feature_cols: Sequence[str], n_folds: int, label: str, folds: Collection[int] | None = None):
        self.data, self.label = data, label
        self._vectors: dict[tuple[int, bool], DataFrame] = {}
        self.numeric, self.categorical = numeric_and_categorical(data, feature_cols)
        cells = {2 * f + t for f in range(n_folds) for t in (0, 1)}
        self.train = {-1: {c for c in cells if c % 2 == 0}} | {f: {c for c in cells if c // 2 != f} for f in range(n_folds)}
        self.train = {s: c for s, c in self.train.items() if folds is None or s in folds}
        self.cell = F.col("fold") * 2 + F.col("is_test").cast("int")
        self.terms = FM.table_terms(data, self.numeric, self.categorical, degree2=False)
        sums = FM.cell_moments(data, self.terms, [label], self.cell)
        self.rows = {s: FM.total(sums, cells) for s, cells in self.train.items()}
        medians = FM.group_medians(data, self.numeric, self.train, self.cell, ends=self.terms.ends)
        self.pre = {s: FM.fitted_preprocessor(self.terms, self.rows[s], medians[s], self.numeric, self.categorical, []) for s in self.train}

    def test_rows(self, subset: int) -> DataFrame:
        return self.data.where(F.col("is_test") if subset == -1 else F.col("fold") == subset)

    def train_rows(self, subset: int) -> DataFrame:
        return self.data.where(~F.col("is_test") if subset == -1 else F.col("fold") != subset)

    def counts(self, subset: int) -> tuple[float, float]:
        one = round(float(self.rows[subset].h[0, 0]))
        return round(self.rows[subset].n) - one, one

    def vectors(self, subset: int, test: bool) -> DataFrame:
        """Preprocessed rows of one side of a split."""
        if (subset, test) not in self._vectors:
            rows = self.test_rows(subset) if test else self.train_rows(subset)
            self._vectors[subset, test] = self.pre[subset].transform(rows, keep=["ID", self.label])
        return self._vectors[subset, test]

    # ---- models of all subsets -------------------------------------------------------------------
    def majority(self) -> dict:
        def predict(subset: int) -> DataFrame:
            zero, one = self.counts(subset)
            mode = int(one > zero)
            return self.test_rows(subset).select("ID", self.label, F.lit(mode).alias("prediction"), F.lit(float(mode)).alias("score"))
        return {s: predict(s) for s in self.train}

    def logistics(self, weightings: Mapping[str, bool]) -> dict[str, dict]:
        """Logistic models by name and subset; all are fitted together."""
        rows = self.data.select(self.cell.cast("long").alias("cell"), self.terms.array().alias("z"), F.col(self.label).cast("int").alias("y"))
        fits = {(name, s): newton.Fit(cells, _balanced(*self.counts(s)) if balanced else (1.0, 1.0), FM.design(self.terms, self.pre[s], False))
                for name, balanced in weightings.items() for s, cells in self.train.items()}
        models = newton.fit_many(rows, fits)
        return {name: {s: models[name, s].transform(self.vectors(s, True), self.label) for s in self.train} for name in weightings}

    def trees(self) -> dict:
        """Exact trees on raw values with the subset's fills: scaling does not change a split."""
        columns = [f"cast({quoted(c)} as double)" for c in self.numeric]
        columns += [f"cast({quoted(c)} = {text(lv)} as double)" for c in self.categorical for lv in self.terms.levels[c]]
        raw = F.expr(f"array({', '.join(columns)})")
        rows = self.data.select(self.cell.cast("long").alias("cell"), raw.alias("x"), F.col(self.label).cast("int").alias("y"))

        def fill(s: int) -> np.ndarray:
            pre = self.pre[s]
            return np.array([pre.medians[c] if pre.medians[c] is not None else 0.0 for c in self.numeric]
                            + [float(pre.modes[c] == lv) for c in self.categorical for lv in self.terms.levels[c]])
        found = cart.grow(rows, {s: cart.Tree(cells, _balanced(*self.counts(s)), fill(s)) for s, cells in self.train.items()})
        return {s: found[s].transform(self.test_rows(s), self.label, raw) for s in self.train}


_BUILT_IN = {name: name for name in CLASSIFIER_NAMES}


def prediction_table(data: DataFrame, feature_cols: Sequence[str], models: Sequence[str] | Mapping[str, object] = CLASSIFIER_NAMES,
                     n_folds: int = 5, label: str = LABEL, folds: Collection[int] | None = None) -> DataFrame:
    """All out-of-fold and holdout predictions: (model, fold, ID, label, prediction, score).

    ``data`` (stored) carries ``ID``, the features, ``label``, ``is_test`` and ``fold``.  Preprocessing (T5) is fitted once per split and shared by every
    model; the logistic models of all splits take their steps together, and so do the trees.  Folds cover all rows, holdout
    included, as in the published protocol.  ``models`` are known names, or a mapping of names to known names, Spark ML estimators or
    functions (``operators.models``).  ``folds`` names the values of ``fold`` wanted, all unless given: a split's predictions do not depend on the other splits.
    """
    chosen = as_mapping(models, _BUILT_IN)
    fits = SplitFits(data, feature_cols, n_folds, label, folds)
    known = {name: m for name, m in chosen.items() if isinstance(m, str)}
    balanced = {"logistic_regression": False, "logistic_regression_balanced": True}
    logistic = {name: balanced[m] for name, m in known.items() if m in balanced}
    found: dict[str, dict] = fits.logistics(logistic) if logistic else {}
    for name, m in chosen.items():
        if name in found:
            continue
        if m == "dummy_most_frequent":
            found[name] = fits.majority()
        elif m == "decision_tree_balanced":
            found[name] = fits.trees()
        else:
            predict = predict_knn if m == "knn_k15" else as_classifier(m)
            found[name] = {}
            for s in fits.train:
                train, test = fits.vectors(s, False), fits.vectors(s, True)
                found[name][s] = predict(train, test, label=label) if m == "knn_k15" else predict(train, test, label)
    out = None
    for name, by_subset in found.items():
        for fold, p in by_subset.items():
            one = p.select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), "ID", F.col(label).cast("int").alias(label),
                           F.col("prediction").cast("int").alias("prediction"), F.col("score").cast("double").alias("score"))
            out = one if out is None else out.unionByName(one)
    return materialize(out)  # one write of the long prediction table


def compare_classifiers(pred: DataFrame, label: str = LABEL) -> DataFrame:
    """Holdout metrics and the mean of the fold metrics per model, best F1 first."""
    m = binary_metrics(pred, ["model", "fold"], label).join(roc_auc(pred, ["model", "fold"], label),
                                                           ["model", "fold"])
    names = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    test = m.filter(F.col("fold") == -1).select("model", *[F.col(c).alias(f"test_{c}") for c in names])
    cv = m.filter(F.col("fold") >= 0).groupBy("model").agg(*[F.avg(c).alias(f"cv_{c}_mean") for c in names])
    return test.join(cv, "model")


def ranked_models(results: DataFrame) -> DataFrame:
    """Rank by test F1 (desc), ties by name; rank 1 = best model (5 rows)."""
    from pyspark.sql import Window
    w = Window.orderBy(F.col("test_f1").desc(), "model")
    return results.withColumn("rank", F.row_number().over(w))
