"""Classification queries.

SQL-checked: class weights, the majority baseline, exact 15-NN (the oracle runs
brute force over all test x train pairs, fine at the check scale) and the
metrics of the k-NN holdout predictions, some Newton steps and the root split of the tree.  Fits run to the
end and the cross-validated comparison are rows-only checks.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from marketlens.operators import cart, classify as C, features as P, knn, newton, prep, split as S
from marketlens.plans.oracle import fragment, sql_with
from marketlens.plans.q_prep import CLS_NUMERIC
from marketlens.plans.q_prepare import cls_clean
from marketlens.plans.registry import register, kept_result
from marketlens.schema import CATEGORICAL_COLUMNS, CLASSIFICATION_FEATURES
from marketlens.session import materialize
from marketlens.sources import files

L = C.LABEL


def cls_data(spark, sf):
    """ID, 29 features, label, stratified holdout flag and stratified fold (all rows)."""
    fm = P.feature_matrix(cls_clean(spark, sf)).withColumnRenamed("Response", L)
    return S.split_and_folds(fm, strata=[L])


def holdout_vectors(spark, sf):
    d = materialize(cls_data(spark, sf))
    train, test = d.filter(~F.col("is_test")), d.filter("is_test")
    fitted = prep.fit_by_dtype(train, CLASSIFICATION_FEATURES)
    return fitted.transform(train, keep=["ID", L]), fitted.transform(test, keep=["ID", L])


def holdout_predictions(spark, sf, model: str):
    tr, te = holdout_vectors(spark, sf)
    pred = C.predict_knn(tr, te, max_train_rows=knn.MAX_TRAIN_ROWS) if model == "knn_k15" else C.fit_predict(model, tr, te)  # the bound of knn_nb
    return pred.select(F.lit(model).alias("model"), F.lit(-1).alias("fold"), "ID",
                                               F.col(L).cast("int").alias(L), "prediction", "score")


@kept_result("classifier_predictions")
def all_predictions(spark, sf):
    d = materialize(cls_data(spark, sf))  # cut lineage once: every fit reads this
    return C.prediction_table(d, CLASSIFICATION_FEATURES)


# --- SQL fragments ------------------------------------------------------------------------
def _mode_sql(c: str) -> str:
    return (f"(SELECT {c} FROM cls_split WHERE NOT is_test AND {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


_scaled = ", ".join(f"(coalesce(CAST(a.{c} AS DOUBLE), k.med_{c}) - k.mu_{c}) / "
                    f"(CASE WHEN k.sd_{c} IS NULL OR k.sd_{c} < {prep.ZERO_SCALE!r} THEN 1 ELSE k.sd_{c} END) AS {c}"
                    for c in CLS_NUMERIC)
fragment("cls_vec", f"SELECT a.ID, a.is_test, a.Response AS label, {_scaled}, "
         + ", ".join(f"coalesce(a.{c}, {_mode_sql(c)}) AS {c}" for c in CATEGORICAL_COLUMNS)
         + " FROM cls_split a CROSS JOIN cls_scale_consts k", ("cls_split", "cls_scale_consts"))
_d2 = " + ".join(f"(q.{c} - t.{c}) * (q.{c} - t.{c})" for c in CLS_NUMERIC)
_cat = " + ".join(
    f"CASE WHEN q.{c} = t.{c} THEN 0 WHEN q.{c} IN (SELECT DISTINCT {c} FROM cls_vec WHERE NOT is_test) THEN 2 ELSE 1 END"
    for c in CATEGORICAL_COLUMNS)
fragment("knn_nb", f"SELECT q.ID AS qid, t.ID AS tid, t.label, row_number() OVER (PARTITION BY q.ID ORDER BY "
         f"({_d2}) + ({_cat}), t.ID) AS rn FROM (SELECT * FROM cls_vec WHERE is_test) q, "
         f"({knn.fitted_rows_sql('(SELECT * FROM cls_vec WHERE NOT is_test)')}) t", ("cls_vec",))
fragment("knn_pred", "SELECT 'knn_k15' AS model, -1 AS fold, n.qid AS ID, v.label, "
         "CAST(avg(n.label) > 0.5 AS INTEGER) AS prediction, avg(CAST(n.label AS DOUBLE)) AS score "
         "FROM knn_nb n JOIN cls_vec v ON v.ID = n.qid WHERE n.rn <= 15 GROUP BY n.qid, v.label", ("knn_nb", "cls_vec"))

_COUNTS = ("CAST(count_if(label = 1 AND prediction = 1) AS BIGINT) AS tp, CAST(count_if(label = 0 AND prediction = 1) AS BIGINT) AS fp, "
           "CAST(count_if(label = 1 AND prediction = 0) AS BIGINT) AS fn, CAST(count_if(label = 0 AND prediction = 0) AS BIGINT) AS tn")


def _sd(n, d):
    return f"coalesce(CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0), 0)"


fragment("knn_counts", f"SELECT model, fold, {_COUNTS} FROM knn_pred GROUP BY model, fold", ("knn_pred",))

# --- M4, M1, M5 -------------------------------------------------------------------------
register("balanced_class_weight", sql_with(
    "SELECT Response AS label, CAST(count(*) AS BIGINT) AS n_c, "
    "(SELECT count(*) FROM cls_split WHERE NOT is_test) / (2.0 * count(*)) AS weight "
    "FROM cls_split WHERE NOT is_test GROUP BY Response", "cls_split"))(
    lambda spark, sf: C.class_weights(cls_data(spark, sf).filter(~F.col("is_test"))))
register("majority_baseline", sql_with(
    "SELECT ID, Response AS label, m.m AS prediction, CAST(m.m AS DOUBLE) AS score FROM cls_split CROSS JOIN "
    "(SELECT Response AS m FROM cls_split WHERE NOT is_test GROUP BY Response ORDER BY count(*) DESC, Response LIMIT 1) m "
    "WHERE is_test", "cls_split"))(
    lambda spark, sf: (lambda d: C.predict_majority(d.filter(~F.col("is_test")), d.filter("is_test")))(
        cls_data(spark, sf)))
@register("knn_neighbours", sql_with(
    "SELECT qid, tid, CAST(rn AS INTEGER) AS rank FROM knn_nb WHERE rn <= 15", "knn_nb"))
def q_knn_neighbours(spark, sf):
    tr, te = holdout_vectors(spark, sf)
    nb = knn.knn_neighbours(tr.select("ID", vector_to_array("features").alias("vec")),
                            te.select("ID", vector_to_array("features").alias("vec")), 15)
    return nb.select("qid", "tid", F.col("rank").cast("int"))


register("knn_classify", sql_with("SELECT ID, label, prediction, score FROM knn_pred", "knn_pred"))(
    lambda spark, sf: holdout_predictions(spark, sf, "knn_k15").drop("model", "fold"))

# --- E1-E4 on the k-NN holdout predictions ------------------------------------------------------
register("binary_metrics", sql_with(
    f"SELECT model, fold, tp, fp, fn, tn, {_sd('tp + tn', 'tp + fp + fn + tn')} AS accuracy, "
    f"{_sd('tp', 'tp + fp')} AS precision, {_sd('tp', 'tp + fn')} AS recall, {_sd('2 * tp', '2 * tp + fp + fn')} AS f1 "
    "FROM knn_counts", "knn_counts"))(
    lambda spark, sf: C.binary_metrics(holdout_predictions(spark, sf, "knn_k15")))
register("roc_auc", sql_with(
    "SELECT model, fold, (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / "
    "nullif(sum(label) * sum(1 - label), 0) AS roc_auc FROM (SELECT *, rank() OVER (PARTITION BY model, fold ORDER BY score) "
    "+ (count(*) OVER (PARTITION BY model, fold, score) - 1) / 2.0 AS r FROM knn_pred) GROUP BY model, fold", "knn_pred"))(
    lambda spark, sf: C.roc_auc(holdout_predictions(spark, sf, "knn_k15")))
register("confusion_matrix", sql_with(
    "SELECT 'knn_k15' AS model, 'actual_' || CAST(c.y AS VARCHAR) AS actual, "
    "CAST(count_if(p.prediction = 0) AS BIGINT) AS pred_0, CAST(count_if(p.prediction = 1) AS BIGINT) AS pred_1 "
    "FROM (SELECT unnest([0, 1]) AS y) c LEFT JOIN knn_pred p ON p.label = c.y GROUP BY c.y", "knn_pred"))(
    lambda spark, sf: C.confusion_matrix(holdout_predictions(spark, sf, "knn_k15")))
_rep = [
    ("'No Response'", _sd("tn", "tn + fn"), _sd("tn", "tn + fp"), _sd("2 * tn", "2 * tn + fn + fp"), "tn + fp"),
    ("'Response'", _sd("tp", "tp + fp"), _sd("tp", "tp + fn"), _sd("2 * tp", "2 * tp + fp + fn"), "tp + fn"),
    ("'accuracy'", _sd("tp + tn", "tp + fp + fn + tn"), _sd("tp + tn", "tp + fp + fn + tn"),
     _sd("tp + tn", "tp + fp + fn + tn"), "tp + fp + fn + tn"),
    ("'macro avg'", f"({_sd('tn', 'tn + fn')} + {_sd('tp', 'tp + fp')}) / 2",
     f"({_sd('tn', 'tn + fp')} + {_sd('tp', 'tp + fn')}) / 2",
     f"({_sd('2 * tn', '2 * tn + fn + fp')} + {_sd('2 * tp', '2 * tp + fp + fn')}) / 2", "tp + fp + fn + tn"),
    ("'weighted avg'", _sd(f"{_sd('tn', 'tn + fn')} * (tn + fp) + {_sd('tp', 'tp + fp')} * (tp + fn)", "tp + fp + fn + tn"),
     _sd(f"{_sd('tn', 'tn + fp')} * (tn + fp) + {_sd('tp', 'tp + fn')} * (tp + fn)", "tp + fp + fn + tn"),
     _sd(f"{_sd('2 * tn', '2 * tn + fn + fp')} * (tn + fp) + {_sd('2 * tp', '2 * tp + fp + fn')} * (tp + fn)",
         "tp + fp + fn + tn"), "tp + fp + fn + tn"),
]
register("classification_report", sql_with(" UNION ALL ".join(
    f"SELECT model, {lab} AS label, {p} AS precision, {r} AS recall, {f} AS f1_score, CAST({s} AS DOUBLE) AS support "
    "FROM knn_counts" for lab, p, r, f, s in _rep), "knn_counts"))(
    lambda spark, sf: C.classification_report(holdout_predictions(spark, sf, "knn_k15")))


# --- W10: first 30 holdout rows by ID with actual / majority prediction ----------------------------------
@register("prediction_sample", sql_with(
    "SELECT ID, " + ", ".join(CLASSIFICATION_FEATURES) + ", Response AS actual_Response, m.m AS predicted_Response "
    "FROM cls_split CROSS JOIN (SELECT Response AS m FROM cls_split WHERE NOT is_test GROUP BY Response "
    "ORDER BY count(*) DESC, Response LIMIT 1) m WHERE is_test ORDER BY ID LIMIT 30", "cls_split"))
def q_prediction_sample(spark, sf, n: int = 30):
    d = cls_data(spark, sf)
    pred = C.predict_majority(d.filter(~F.col("is_test")), d.filter("is_test"))
    rows = d.filter("is_test").select("ID", *CLASSIFICATION_FEATURES).join(pred, "ID")
    return (rows.orderBy("ID").limit(n)
            .select("ID", *CLASSIFICATION_FEATURES, F.col(L).cast("int").alias("actual_Response"),
                    F.col("prediction").alias("predicted_Response")))


# --- rows-only: fits run to the end, CV, comparison --------------------------------------------------------------
register("logistic", note="M2")(lambda spark, sf: holdout_predictions(spark, sf, "logistic_regression"))
register("logistic_balanced", note="M3")(
    lambda spark, sf: holdout_predictions(spark, sf, "logistic_regression_balanced"))
register("decision_tree_balanced", note="M6")(
    lambda spark, sf: holdout_predictions(spark, sf, "decision_tree_balanced"))
register("cross_validate", note="V5: out-of-fold + holdout prediction table of all five models")(all_predictions)
register("compare_classifiers", note="E6: holdout and 5-fold CV metrics per model")(
    lambda spark, sf: C.compare_classifiers(all_predictions(spark, sf)))
register("rank_models", note="W8: models by test F1")(
    lambda spark, sf: C.ranked_models(C.compare_classifiers(all_predictions(spark, sf))))


# --- W8 on two models that SQL can state: k-NN and the majority class ------------------------------------------------
fragment("two_preds", "SELECT model, label, prediction FROM knn_pred UNION ALL SELECT 'dummy_most_frequent', Response, m.m FROM cls_split "
         "CROSS JOIN (SELECT Response AS m FROM cls_split WHERE NOT is_test GROUP BY Response ORDER BY count(*) DESC, Response LIMIT 1) m "
         "WHERE is_test", ("knn_pred", "cls_split"))


@register("rank_two_models", sql_with(
    f"SELECT model, test_accuracy, test_f1, CAST(row_number() OVER (ORDER BY test_f1 DESC, model) AS INTEGER) AS rank FROM (SELECT model, "
    f"{_sd('tp + tn', 'tp + fp + fn + tn')} AS test_accuracy, {_sd('2 * tp', '2 * tp + fp + fn')} AS test_f1 FROM (SELECT model, {_COUNTS} "
    "FROM two_preds GROUP BY model))", "two_preds"), note="W8")
def q_rank_two_models(spark, sf):
    pred = holdout_predictions(spark, sf, "knn_k15").unionByName(holdout_predictions(spark, sf, "dummy_most_frequent"))
    m = C.binary_metrics(pred, ["model"]).select("model", F.col("accuracy").alias("test_accuracy"), F.col("f1").alias("test_f1"))
    return C.ranked_models(m).withColumn("rank", F.col("rank").cast("int"))


@kept_result("holdout_predictions")
def _holdout_fits(spark, sf):
    return C.prediction_table(materialize(cls_data(spark, sf)), CLASSIFICATION_FEATURES, folds=(-1,))


def _holdout_all(spark, sf):
    """Holdout rows of the predictions of all five models; the folds are not fitted for them."""
    every = all_predictions.kept(spark, sf)
    return _holdout_fits(spark, sf) if every is None else every.filter(F.col("fold") == -1)


register("confusion_matrices", note="E3 for all five models on the holdout")(
    lambda spark, sf: C.confusion_matrix(_holdout_all(spark, sf)))
register("classification_reports", note="E4 for all five models on the holdout")(
    lambda spark, sf: C.classification_report(_holdout_all(spark, sf)))


@register("classification_report_json", note="S6: report documents of all five models as JSON strings")
def q_classification_report_json(spark, sf):
    rep = C.classification_report(_holdout_all(spark, sf))
    doc = rep.groupBy("model").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
        "label", F.struct("precision", "recall", F.col("f1_score").alias("f1-score"), "support"))))).alias("report"))
    path = files.write_json_documents(doc, files.scratch_path(spark, "reports"), "model")  # one file for each model
    return spark.read.schema("value string, model string").text(path).select(
        "model", F.from_json("value", "report string")["report"].alias("report"))


@register("prediction_samples", note="W10 for all five models: first 30 holdout rows by ID with actual / predicted")
def q_prediction_samples(spark, sf, n: int = 30):
    pred = _holdout_all(spark, sf)
    feats = cls_data(spark, sf).filter("is_test").select("ID", *CLASSIFICATION_FEATURES)
    parts = []
    for name in C.CLASSIFIER_NAMES:
        top = pred.filter(F.col("model") == name).orderBy("ID").limit(n)  # bounded top-n per task, then merged
        parts.append(top.join(feats, "ID").select(
            "model", "ID", *CLASSIFICATION_FEATURES, F.col(L).alias("actual_Response"),
            F.col("prediction").alias("predicted_Response")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- M2 / M3: Newton steps from zero on two features, solved by Cramer's rule in SQL ----------------------------------
NEWTON_FEATURES = ["Income", "Recency"]


def _newton_sql(steps: int = 3) -> str:
    x1, x2 = NEWTON_FEATURES
    parts = [f"rows_ AS (SELECT m.model, {x1} AS x1, {x2} AS x2, label AS y, CASE WHEN m.model = 'logistic_regression' THEN 1.0 ELSE "
             "(SELECT count(*) FROM cls_vec WHERE NOT is_test) / (2.0 * (SELECT count(*) FROM cls_vec o WHERE NOT o.is_test AND o.label = v.label)) END AS w "
             "FROM cls_vec v, (SELECT unnest(['logistic_regression', 'logistic_regression_balanced']) AS model) m WHERE NOT is_test)",
             "b0 AS (SELECT DISTINCT model, CAST(0 AS DOUBLE) AS i, CAST(0 AS DOUBLE) AS u, CAST(0 AS DOUBLE) AS v FROM rows_)"]
    for k in range(steps):
        parts.append(f"p{k} AS (SELECT r.*, b.i, b.u, b.v, 1 / (1 + exp(-(b.i + b.u * x1 + b.v * x2))) AS p FROM rows_ r JOIN b{k} b USING (model))")
        parts.append(f"h{k} AS (SELECT model, i, u, v, sum(w*p*(1-p)) AS a, sum(w*p*(1-p)*x1) AS b, sum(w*p*(1-p)*x2) AS c, sum(w*p*(1-p)*x1*x1) + 1 AS d, "
                     f"sum(w*p*(1-p)*x1*x2) AS e, sum(w*p*(1-p)*x2*x2) + 1 AS f, sum(w*(p-y)) AS g0, sum(w*(p-y)*x1) + u AS g1, sum(w*(p-y)*x2) + v AS g2 "
                     f"FROM p{k} GROUP BY model, i, u, v)")
        parts.append(f"b{k + 1} AS (SELECT model, i - ((d*f-e*e)*g0 + (c*e-b*f)*g1 + (b*e-c*d)*g2) / t AS i, u - ((c*e-b*f)*g0 + (a*f-c*c)*g1 + (b*c-a*e)*g2) / t AS u, "
                     f"v - ((b*e-c*d)*g0 + (b*c-a*e)*g1 + (a*d-b*b)*g2) / t AS v FROM (SELECT *, a*(d*f-e*e) - b*(b*f-c*e) + c*(b*e-c*d) AS t FROM h{k}))")
    return ("SELECT * FROM (WITH " + ", ".join(parts) + f" SELECT model, 'intercept' AS term, i AS value FROM b{steps} UNION ALL SELECT model, '{x1}', u FROM b{steps} "
            f"UNION ALL SELECT model, '{x2}', v FROM b{steps})")


@register("logistic_newton_steps", sql_with(_newton_sql(), "cls_vec"), note="M2 / M3: coefficients after three Newton steps from zero, both weightings")
def q_logistic_newton_steps(spark, sf, steps: int = 3):
    train = materialize(cls_data(spark, sf).filter(~F.col("is_test")))
    pre = prep.fit_preprocessor(train, numeric=NEWTON_FEATURES)
    rows = train.select(F.lit(0).cast("long").alias("cell"), F.array(*pre.output_exprs()).alias("z"), F.col(L).cast("int").alias("y"))
    weights = {r[L]: r["weight"] for r in C.class_weights(train).collect()}
    design = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    fits = {"logistic_regression": newton.Fit({0}, (1.0, 1.0), design), "logistic_regression_balanced": newton.Fit({0}, (weights[0], weights[1]), design)}
    models = newton.fit_many(rows, fits, max_steps=steps, tolerance=0.0)
    table = [(name, term, float(v)) for name, m in models.items() for term, v in zip(["intercept", *NEWTON_FEATURES], [m.intercept, *m.coefficients])]
    return spark.createDataFrame(table, "model string, term string, value double")


# --- M6: the root split over the numeric features -----------------------------------------------------------
def _root_sql() -> str:
    long = " UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS feature, coalesce(CAST(a.{c} AS DOUBLE), k.med_{c}) AS v, a.Response AS y "
                              f"FROM cls_split a CROSS JOIN cls_scale_consts k WHERE NOT a.is_test" for i, c in enumerate(CLS_NUMERIC))
    weight = lambda y: f"(SELECT count(*) / (2.0 * count_if(Response = {y})) FROM cls_split WHERE NOT is_test)"
    purity = lambda a, b: f"(({a}*w0)*({a}*w0) + ({b}*w1)*({b}*w1)) / ({a}*w0 + {b}*w1)"
    return (f"SELECT * FROM (WITH n AS (SELECT place, feature, v, count_if(y = 0) AS c0, count_if(y = 1) AS c1 FROM ({long}) GROUP BY place, feature, v), "
            f"r AS (SELECT *, sum(c0) OVER before AS l0, sum(c1) OVER before AS l1, sum(c0) OVER everything AS n0, sum(c1) OVER everything AS n1, "
            f"lead(v) OVER (PARTITION BY feature ORDER BY v) AS next, {weight(0)} AS w0, {weight(1)} AS w1 FROM n "
            "WINDOW before AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING), everything AS (PARTITION BY feature)) "
            f"SELECT feature, (v + next) / 2 AS threshold, CAST(l0 + l1 AS BIGINT) AS n_left, CAST(n0 + n1 - l0 - l1 AS BIGINT) AS n_right FROM r "
            f"WHERE l0 + l1 >= {cart.MIN_LEAF} AND n0 + n1 - l0 - l1 >= {cart.MIN_LEAF} "
            f"ORDER BY -({purity('l0', 'l1')} + {purity('(n0-l0)', '(n1-l1)')}), place, v LIMIT 1)")


@register("tree_root_split", sql_with(_root_sql(), "cls_split", "cls_scale_consts"), note="M6: exact root split of the balanced tree over the numeric features")
def q_tree_root_split(spark, sf):
    train = materialize(cls_data(spark, sf).filter(~F.col("is_test")))
    pre = prep.fit_preprocessor(train, numeric=CLS_NUMERIC)
    rows = train.select(F.lit(0).cast("long").alias("cell"), F.array(*[F.col(c).cast("double") for c in CLS_NUMERIC]).alias("x"), F.col(L).cast("int").alias("y"))
    weights = {r[L]: r["weight"] for r in C.class_weights(train).collect()}
    tree = cart.grow(rows, {0: cart.Tree({0}, (weights[0], weights[1]), np.array([pre.medians[c] or 0.0 for c in CLS_NUMERIC]))}, max_depth=1)[0]
    table = [(CLS_NUMERIC[i], float(t), sum(tree.counts[2]), sum(tree.counts[3])) for i, t in tree.splits.values()]
    return spark.createDataFrame(table, "feature string, threshold double, n_left long, n_right long")
