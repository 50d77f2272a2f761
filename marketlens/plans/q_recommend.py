"""Recommendation analytics and split queries.

Model-free stand-ins keep these SQL-checkable: the *flagship recommendation*
ranks products by the customer's own share relative to the train prior
(S2 -> P11 -> V2 -> A2 -> X2 -> W5-W7); diagnostics compare it with the
customer's most-bought product; regression metrics score the
non-personalised prior as a prediction.  The same operators run on model
predictions inside the recommender comparison (E7/E9).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from marketlens.functions.rowexpr import top1_product
from marketlens.operators import features as P, recommend as R, split as S
from marketlens.plans.oracle import (banner_order_sql, banner_scores_sql, fragment, nz_sum, sdiv, sql_with,
                                     top1_sql)
from marketlens.plans.q_prepare import cls_clean, reg_prepared
from marketlens.plans.registry import register
from marketlens.schema import LOG_NUMERIC_CANDIDATES, PRODUCT_COLUMNS

PC = PRODUCT_COLUMNS


# --- shared Spark pipelines -------------------------------------------------
def reg_split(spark, sf):
    """Valid customers (positive spend) with six shares and the 80/20 test flag.

    Persisted: the flag table feeds both the train prior and the scored rows,
    so the two shuffles of the hash rank run once.
    """
    return S.split_flag(P.spending_share_target(reg_prepared(spark, sf)), 0.2).persist(StorageLevel.MEMORY_AND_DISK)


def train_prior(split_df):
    return R.product_prior(split_df.filter(~F.col("is_test")))


def flagship(spark, sf):
    sp = reg_split(spark, sf)
    rel = R.relative_preference(sp, train_prior(sp))
    return R.add_banner(R.with_top1(rel, "Recommended_Product"))


def flagship_with_raw(spark, sf):
    """Flagship recommendation plus the most-bought product (raw share top 1)."""
    prepared = reg_prepared(spark, sf)
    sp = S.split_flag(P.spending_share_target(prepared, keep=["Income", "HasPartner", "TotalChildren"]), 0.2) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    raw_top = sp.withColumn("Most_Bought_Product", top1_product(PC, PC))
    rel = R.relative_preference(raw_top, train_prior(sp))
    return R.with_top1(rel, "Recommended_Product")


# --- SQL fragments -------------------------------------------------------------
_REL = [f"r.{c}" for c in PC]
fragment("flagship", "SELECT r.ID, r.is_test, " + ", ".join(f"r.{c}" for c in PC)
         + f", {top1_sql(_REL, PC)} AS Recommended_Product, {banner_order_sql(_REL, PC)} AS Banner_Ad_Order, "
         f"{banner_scores_sql(_REL, PC)} AS Banner_Ad_Scores FROM reg_relative r", ("reg_relative",))
fragment("flagship_raw",
         "SELECT f.ID, f.is_test, f.Recommended_Product, "
         f"{top1_sql([f's.{c}' for c in PC], PC)} AS Most_Bought_Product, p.Income, p.HasPartner, p.TotalChildren "
         "FROM flagship f JOIN reg_split s ON f.ID = s.ID JOIN reg_prepared p ON f.ID = p.ID",
         ("flagship", "reg_split", "reg_prepared"))

# --- A2, X2, W5, A3, A4 ---------------------------------------------------------
register("product_prior", sql_with("SELECT * FROM reg_prior", "reg_prior"))(
    lambda spark, sf: train_prior(reg_split(spark, sf)))
register("relative_preference", sql_with("SELECT * FROM reg_relative", "reg_relative"))(
    lambda spark, sf: (lambda sp: R.relative_preference(sp, train_prior(sp)))(reg_split(spark, sf)))
register("top1_product", sql_with("SELECT ID, Actual_Product FROM reg_top1", "reg_top1"))(
    lambda spark, sf: R.with_top1(
        (lambda sp: R.relative_preference(sp, train_prior(sp)))(reg_split(spark, sf)), "Actual_Product")
    .select("ID", "Actual_Product"))


def _actual_top1(spark, sf):
    sp = reg_split(spark, sf)
    return R.with_top1(R.relative_preference(sp, train_prior(sp)), "Actual_Product")


register("baseline_product", sql_with("SELECT * FROM reg_baseline", "reg_baseline"))(
    lambda spark, sf: R.baseline_product(_actual_top1(spark, sf).filter(~F.col("is_test"))))


@register("baseline_match_rate", sql_with(
    "SELECT b.baseline_product, avg(CAST(t.Actual_Product = b.baseline_product AS DOUBLE)) AS match_rate "
    "FROM reg_top1 t CROSS JOIN reg_baseline b WHERE t.is_test GROUP BY b.baseline_product",
    "reg_top1", "reg_baseline"))
def q_baseline_match_rate(spark, sf):
    top = _actual_top1(spark, sf)
    base = R.baseline_product(top.filter(~F.col("is_test")))
    test = top.filter("is_test").crossJoin(F.broadcast(base))
    return R.match_rate(test, "Actual_Product", "baseline_product", ["baseline_product"])


# --- flagship: W6/W7 ------------------------------------------------------------
register("banner_recommendation", sql_with("SELECT * FROM flagship", "flagship"),
         note="flagship: relative-preference ranking per customer")(flagship)
register("banner_positions", sql_with(
    "SELECT ID, CAST(generate_subscripts(string_split(Banner_Ad_Order, ' > '), 1) AS INTEGER) AS position, "
    "unnest(string_split(Banner_Ad_Order, ' > ')) AS Product FROM flagship", "flagship"))(
    lambda spark, sf: R.banner_positions(flagship(spark, sf)).withColumn("position", F.col("position").cast("int")))

# --- X1 normalise (raw = share - prior) -----------------------------------------------


@register("normalize_shares", sql_with(
    "SELECT ID, " + ", ".join(f"{sdiv(f'greatest(s.{c} - p.prior_{c}, 0)', 'rs.t')} AS {c}" for c in PC)
    + " FROM reg_split s CROSS JOIN reg_prior p CROSS JOIN LATERAL (SELECT "
    + " + ".join(f"greatest(s.{c} - p.prior_{c}, 0)" for c in PC) + " AS t) rs",
    "reg_split", "reg_prior"))
def q_normalize_shares(spark, sf):
    sp = reg_split(spark, sf)
    prior = train_prior(sp)
    raw = sp.crossJoin(F.broadcast(prior)).select(
        "ID", *[(F.col(c) - F.col(R.PRIOR_PREFIX + c)).alias(c) for c in PC])
    return R.normalize_shares(raw)


# --- E8 / R3 / R4 / W9 (identity stand-in predictions on the test rows) ------------------------------
def _stand_in_frame(spark, sf):
    sp = reg_split(spark, sf)
    prior = train_prior(sp)
    test = sp.filter("is_test").select("ID", *PC)
    return R.prediction_frame(test, R.normalize_shares(test), prior)


_ACT = [f"s.{c}" for c in PC]
_PRED_RS = " + ".join(f"greatest(s.{c}, 0)" for c in PC)
fragment("stand_in_frame", "SELECT s.ID, "
         + ", ".join(f"s.{c} AS ActualRatio_{c}" for c in PC) + ", "
         + ", ".join(f"{sdiv(f'greatest(s.{c}, 0)', _PRED_RS)} AS PredictedRatio_{c}" for c in PC) + ", "
         + ", ".join(f"r.{c} AS ActualRelativeScore_{c}" for c in PC) + ", "
         + ", ".join(f"{sdiv(sdiv(f'greatest(s.{c}, 0)', _PRED_RS), 'p.prior_' + c)} AS RecommendationScore_{c}"
                     for c in PC)
         + " FROM reg_split s JOIN reg_relative r ON s.ID = r.ID CROSS JOIN reg_prior p WHERE s.is_test",
         ("reg_split", "reg_relative", "reg_prior"))
_A = [f"ActualRelativeScore_{c}" for c in PC]
_RS = [f"RecommendationScore_{c}" for c in PC]
fragment("stand_in_full", f"SELECT *, {top1_sql(_A, PC)} AS Actual_Product, {top1_sql(_RS, PC)} AS Recommended_Product, "
         f"{top1_sql(_A, PC)} = {top1_sql(_RS, PC)} AS Recommendation_Match, "
         f"{banner_order_sql(_RS, PC)} AS Banner_Ad_Order, {banner_scores_sql(_RS, PC)} AS Banner_Ad_Scores "
         "FROM stand_in_frame", ("stand_in_frame",))
register("prediction_frame", sql_with("SELECT * FROM stand_in_full", "stand_in_full"))(_stand_in_frame)
register("prefix_columns", sql_with(
    "SELECT ID, " + ", ".join(f"ActualRatio_{c}" for c in PC) + " FROM stand_in_frame", "stand_in_frame"))(
    lambda spark, sf: R.prefix_columns(reg_split(spark, sf).filter("is_test"), "ActualRatio_", PC))
register("banner_output", sql_with(
    "SELECT ID, Actual_Product, Recommended_Product, Recommendation_Match, Banner_Ad_Order, Banner_Ad_Scores "
    "FROM stand_in_full", "stand_in_full"))(lambda spark, sf: R.banner_output(_stand_in_frame(spark, sf)))
register("customer_score_table", sql_with(
    "SELECT ID, Product, RecommendationScore, CAST(row_number() OVER (ORDER BY RecommendationScore DESC, pos) AS INTEGER) AS rank "
    "FROM (SELECT ID, unnest([" + ", ".join(f"'{c}'" for c in PC) + "]) AS Product, "
    "unnest([" + ", ".join(f"RecommendationScore_{c}" for c in PC) + "]) AS RecommendationScore, "
    "unnest(range(" + str(len(PC)) + ")) AS pos FROM stand_in_frame WHERE ID = (SELECT min(ID) FROM stand_in_frame))",
    "stand_in_frame"))(
    lambda spark, sf: R.customer_score_table(_stand_in_frame(spark, sf)).withColumn("rank", F.col("rank").cast("int")))

# --- A6 / A7 / A8: most-bought vs flagship recommendation (test rows) -------------------------
_CONF = ("SELECT g.p AS Actual_Product, " + ", ".join(
    f"CAST(count_if(t.Recommended_Product = '{c}') AS BIGINT) AS {c}" for c in PC)
    + " FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in PC) + "]) AS p) g "
    "LEFT JOIN (SELECT * FROM flagship_raw WHERE is_test) t ON t.Most_Bought_Product = g.p GROUP BY g.p")
fragment("confusion", _CONF, ("flagship_raw",))


def _diag_input(spark, sf):
    return flagship_with_raw(spark, sf).filter("is_test")


register("product_confusion", sql_with("SELECT * FROM confusion", "confusion"))(
    lambda spark, sf: R.product_confusion(_diag_input(spark, sf), actual="Most_Bought_Product"))
register("product_confusion_rate", sql_with(
    "SELECT Actual_Product, " + ", ".join(f"{sdiv(f'CAST({c} AS DOUBLE)', '(' + ' + '.join(PC) + ')')} AS {c}"
                                          for c in PC) + " FROM confusion", "confusion"))(
    lambda spark, sf: R.product_confusion_rate(
        R.product_confusion(_diag_input(spark, sf), actual="Most_Bought_Product")))
register("product_distribution", sql_with(
    "SELECT g.p AS Product, coalesce((SELECT count(*) FROM flagship_raw WHERE is_test AND Most_Bought_Product = g.p) "
    "/ (SELECT count(*) FROM flagship_raw WHERE is_test), 0) AS Actual, "
    "coalesce((SELECT count(*) FROM flagship_raw WHERE is_test AND Recommended_Product = g.p) "
    "/ (SELECT count(*) FROM flagship_raw WHERE is_test), 0) AS Recommended "
    "FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in PC) + "]) AS p) g", "flagship_raw"))(
    lambda spark, sf: R.product_distribution(_diag_input(spark, sf), actual="Most_Bought_Product"))

# --- A12 / A13: flagship recommendation by segment (all valid customers) ----------------------
register("rec_by_income_band", sql_with(
    "SELECT IncomeGroup, Product, count, count / sum(count) OVER (PARTITION BY IncomeGroup) AS share FROM ("
    "SELECT CASE WHEN f.Income IS NULL THEN 'Unknown' WHEN f.Income <= q.q[1] THEN 'Q1' WHEN f.Income <= q.q[2] THEN 'Q2' "
    "WHEN f.Income <= q.q[3] THEN 'Q3' ELSE 'Q4' END AS IncomeGroup, f.Recommended_Product AS Product, "
    "CAST(count(*) AS BIGINT) AS count FROM flagship_raw f CROSS JOIN "
    "(SELECT quantile_cont(Income, [0.25, 0.5, 0.75]) AS q FROM flagship_raw) q GROUP BY 1, 2)", "flagship_raw"))(
    lambda spark, sf: R.rec_by_income_band(flagship_with_raw(spark, sf)))
register("rec_by_family_segment", sql_with(
    "SELECT HasPartner, HasChildren, Product, count, count / sum(count) OVER (PARTITION BY HasPartner, HasChildren) AS share "
    "FROM (SELECT HasPartner, CAST(TotalChildren > 0 AS INTEGER) AS HasChildren, Recommended_Product AS Product, "
    "CAST(count(*) AS BIGINT) AS count FROM flagship_raw GROUP BY 1, 2, 3)", "flagship_raw"))(
    lambda spark, sf: R.rec_by_family_segment(flagship_with_raw(spark, sf)))


# --- E5: the non-personalised prior as prediction on the test rows ---------------------------
@register("regression_metrics", sql_with(
    "SELECT (" + " + ".join(
        f"CASE WHEN sum(power(s.{c} - m.m_{c}, 2)) = 0 THEN CASE WHEN sum(power(p.prior_{c} - s.{c}, 2)) = 0 THEN 1.0 ELSE 0.0 END "
        f"ELSE 1 - sum(power(p.prior_{c} - s.{c}, 2)) / sum(power(s.{c} - m.m_{c}, 2)) END" for c in PC)
    + f") / {len(PC)} AS r2, (" + " + ".join(f"sum(abs(p.prior_{c} - s.{c}))" for c in PC)
    + f") / (count(*) * {len(PC)}) AS mae, sqrt((" + " + ".join(f"sum(power(p.prior_{c} - s.{c}, 2))" for c in PC)
    + f") / (count(*) * {len(PC)})) AS rmse FROM reg_split s CROSS JOIN reg_prior p CROSS JOIN (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}" for c in PC) + " FROM reg_split WHERE is_test) m WHERE s.is_test",
    "reg_split", "reg_prior"))
def q_regression_metrics(spark, sf):
    sp = reg_split(spark, sf)
    prior = train_prior(sp)
    test = sp.filter("is_test").select("ID", *PC)
    pred = test.select("ID").crossJoin(F.broadcast(prior)).select(
        "ID", *[F.col(R.PRIOR_PREFIX + c).alias(c) for c in PC])
    return R.regression_metrics(test, pred)


# --- X3 ---------------------------------------------------------------------------------
register("log_features", sql_with(
    "SELECT ID, " + ", ".join(f"ln(1 + {c}) AS log_{c}" for c in LOG_NUMERIC_CANDIDATES) + " FROM reg_prepared",
    "reg_prepared"))(
    lambda spark, sf: reg_prepared(spark, sf).select(
        "ID", *[F.log1p(c).alias("log_" + c) for c in LOG_NUMERIC_CANDIDATES]))

# --- V1-V4 ---------------------------------------------------------------------------------
fragment("cls_xy", "SELECT ID, CAST(Response AS INTEGER) AS Response FROM cls_clean", ("cls_clean",))
register("stratified_split", sql_with(
    "SELECT ID, Response, is_test FROM (" + S.split_sql("cls_xy", strata=["Response"]) + ")", "cls_xy"))(
    lambda spark, sf: S.split_flag(cls_clean(spark, sf).select("ID", F.col("Response").cast("int")),
                                   strata=["Response"]))
register("random_split", sql_with("SELECT ID, is_test FROM reg_split", "reg_split"))(
    lambda spark, sf: reg_split(spark, sf).select("ID", "is_test"))
register("stratified_kfold", sql_with(
    "SELECT ID, Response, fold FROM (" + S.fold_sql("cls_xy", strata=["Response"]) + ")", "cls_xy"))(
    lambda spark, sf: S.fold_column(cls_clean(spark, sf).select("ID", F.col("Response").cast("int")),
                                    strata=["Response"]))
register("kfold", sql_with("SELECT ID, fold FROM (" + S.fold_sql("reg_shares") + ")", "reg_shares"))(
    lambda spark, sf: S.fold_column(P.spending_share_target(reg_prepared(spark, sf))).select("ID", "fold"))

# --- named operators of section 2 that are parts of the chains above ----------------------------
register("cross_prior", sql_with("SELECT * FROM reg_relative", "reg_relative"),
         note="J6: shares / broadcast one-row prior")(
    lambda spark, sf: (lambda sp: R.relative_preference(sp, train_prior(sp)))(reg_split(spark, sf)))
register("banner_order", sql_with("SELECT ID, Banner_Ad_Order FROM flagship", "flagship"))(
    lambda spark, sf: flagship(spark, sf).select("ID", "Banner_Ad_Order"))
register("banner_scores", sql_with("SELECT ID, Banner_Ad_Scores FROM flagship", "flagship"))(
    lambda spark, sf: flagship(spark, sf).select("ID", "Banner_Ad_Scores"))
register("align_predictions", sql_with(
    "SELECT ID, " + ", ".join(f"ActualRatio_{c}, PredictedRatio_{c}" for c in PC) + " FROM stand_in_frame",
    "stand_in_frame"), note="J2: actual and predicted frames joined on the key")(
    lambda spark, sf: _stand_in_frame(spark, sf).select(
        "ID", *[x for c in PC for x in (f"ActualRatio_{c}", f"PredictedRatio_{c}")]))


@register("restrict_to_valid", sql_with(
    "SELECT * FROM reg_prepared WHERE ID IN (SELECT ID FROM reg_shares)", "reg_prepared", "reg_shares"),
    note="J3: prepared rows with a valid (positive-spend) target, left semi join")
def q_restrict_to_valid(spark, sf):
    prepared = reg_prepared(spark, sf)
    return prepared.join(P.spending_share_target(prepared).select("ID"), "ID", "left_semi")


@register("match_rate", sql_with(
    "SELECT avg(CAST(f.Recommended_Product = t.Actual_Product AS DOUBLE)) AS match_rate, "
    "(SELECT avg(CAST(t2.Actual_Product = b.baseline_product AS DOUBLE)) FROM reg_top1 t2 CROSS JOIN reg_baseline b "
    "WHERE t2.is_test) AS baseline_match_rate, "
    "avg(CAST(f.Recommended_Product = t.Actual_Product AS DOUBLE)) - (SELECT avg(CAST(t2.Actual_Product = "
    "b.baseline_product AS DOUBLE)) FROM reg_top1 t2 CROSS JOIN reg_baseline b WHERE t2.is_test) AS lift "
    "FROM (SELECT ID, Most_Bought_Product AS Recommended_Product FROM flagship_raw WHERE is_test) f "
    "JOIN reg_top1 t ON f.ID = t.ID", "flagship_raw", "reg_top1", "reg_baseline"),
    note="A4: most-bought recommendation vs relative top product, baseline rate and lift (test rows)")
def q_match_rate(spark, sf):
    top = _actual_top1(spark, sf)
    base = R.baseline_product(top.filter(~F.col("is_test")))
    test = top.filter("is_test")
    b = R.match_rate(test.crossJoin(F.broadcast(base)), "Actual_Product", "baseline_product") \
        .withColumnRenamed("match_rate", "baseline_match_rate")
    rec = test.select("ID", "Actual_Product").join(
        flagship_with_raw(spark, sf).filter("is_test").select("ID", F.col("Most_Bought_Product").alias("rec")), "ID")
    m = R.match_rate(rec, "Actual_Product", "rec")
    return m.crossJoin(F.broadcast(b)).select(
        "match_rate", "baseline_match_rate", (F.col("match_rate") - F.col("baseline_match_rate")).alias("lift"))


# --- comparison tables of two models that SQL can state: the mean share of the other folds, and equal shares -------
fragment("fold_shares", S.fold_sql("reg_shares"), ("reg_shares",))
fragment("fold_means", "SELECT f.fold, " + ", ".join(f"avg(o.{c}) AS m_{c}" for c in PC)
         + " FROM (SELECT DISTINCT fold FROM fold_shares) f JOIN fold_shares o ON o.fold <> f.fold GROUP BY f.fold", ("fold_shares",))
fragment("fold_preds", "SELECT 'other_folds' AS model, s.fold, " + ", ".join(f"s.{c} AS a_{c}, m.m_{c} AS p_{c}" for c in PC)
         + " FROM fold_shares s JOIN fold_means m ON s.fold = m.fold UNION ALL SELECT 'equal', fold, "
         + ", ".join(f"{c}, 1 / 6.0::DOUBLE" for c in PC) + " FROM fold_shares", ("fold_shares", "fold_means"))
fragment("fold_metrics", "SELECT model, fold, (" + " + ".join(
    f"CASE WHEN var_pop(a_{c}) = 0 THEN CASE WHEN sum(power(p_{c} - a_{c}, 2)) = 0 THEN 1.0 ELSE 0.0 END "
    f"ELSE 1 - sum(power(p_{c} - a_{c}, 2)) / (sum(power(a_{c}, 2)) - power(sum(a_{c}), 2) / count(*)) END" for c in PC)
    + f") / {len(PC)} AS r2, (" + " + ".join(f"sum(abs(p_{c} - a_{c}))" for c in PC)
    + f") / (count(*) * {len(PC)}) AS mae, sqrt((" + " + ".join(f"sum(power(p_{c} - a_{c}, 2))" for c in PC)
    + f") / (count(*) * {len(PC)})) AS rmse FROM fold_preds GROUP BY model, fold", ("fold_preds",))


def _fold_metrics(spark, sf):
    d = S.fold_column(P.spending_share_target(reg_prepared(spark, sf))).select("fold", *PC)
    sums = d.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias("s_" + c) for c in PC])
    whole = sums.agg(F.sum("n").alias("all_n"), *[F.sum("s_" + c).alias("all_" + c) for c in PC])
    means = sums.crossJoin(F.broadcast(whole)).select(  # a row for each fold
        "fold", *[((F.col("all_" + c) - F.col("s_" + c)) / (F.col("all_n") - F.col("n"))).alias("p_" + c) for c in PC])
    actual = d.select("fold", *[F.col(c).alias("a_" + c) for c in PC])
    parts = [actual.join(means, "fold").withColumn("model", F.lit("other_folds")),
             actual.select("*", *[F.lit(1 / 6.0).alias("p_" + c) for c in PC], F.lit("equal").alias("model"))]
    return R.metrics_by(parts[0].unionByName(parts[1]), ["model", "fold"])


register("fold_metrics_union", sql_with("SELECT * FROM fold_metrics", "fold_metrics"), note="R2, E5 by model and fold")(_fold_metrics)
register("best_model_per_fold", sql_with(
    "SELECT model, fold, r2, mae, rmse FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(r2, 9) DESC, mae, model) AS rn "
    "FROM fold_metrics) WHERE rn = 1", "fold_metrics"), note="W4")(
    lambda spark, sf: R.best_per_group(_fold_metrics(spark, sf), "fold", [F.round("r2", 9).desc(), "mae", "model"]))
register("fold_r2_mean_std", sql_with(
    "SELECT model, avg(r2) AS r2_mean, stddev_pop(r2) AS r2_std FROM fold_metrics GROUP BY model", "fold_metrics"), note="V6")(
    lambda spark, sf: R.mean_std(_fold_metrics(spark, sf), ["model"]))
register("fold_metrics_melted", sql_with(
    "SELECT model, unnest(['r2_mean', 'r2_std']) AS Metric, unnest([r2_mean, r2_std]) AS R2 FROM (SELECT model, avg(r2) AS r2_mean, "
    "stddev_pop(r2) AS r2_std FROM fold_metrics GROUP BY model)", "fold_metrics"), note="R1")(
    lambda spark, sf: R.melt_metrics(R.mean_std(_fold_metrics(spark, sf), ["model"]), ["model"], ["r2_mean", "r2_std"]))
register("product_diagnostics", sql_with(
    "SELECT 'count' AS \"table\", Actual_Product AS row, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in PC)
    + ", CAST(NULL AS DOUBLE) AS Actual, CAST(NULL AS DOUBLE) AS Recommended FROM confusion UNION ALL SELECT 'rate', Actual_Product, "
    + ", ".join(sdiv(f"CAST({c} AS DOUBLE)", "(" + " + ".join(PC) + ")") for c in PC) + ", NULL, NULL FROM confusion "
    "UNION ALL SELECT 'distribution', g.p, " + ", ".join("NULL" for _ in PC) + ", "
    "coalesce((SELECT count(*) FROM flagship_raw WHERE is_test AND Most_Bought_Product = g.p) / (SELECT count(*) FROM flagship_raw WHERE is_test), 0), "
    "coalesce((SELECT count(*) FROM flagship_raw WHERE is_test AND Recommended_Product = g.p) / (SELECT count(*) FROM flagship_raw WHERE is_test), 0) "
    "FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in PC) + "]) AS p) g", "confusion", "flagship_raw"), note="E10")(
    lambda spark, sf: R.product_diagnostics(_diag_input(spark, sf), actual="Most_Bought_Product"))
