"""Recommender model queries (M11-M14, T5-T6, E7, E9, E10, W4, R1, R2): rows-only checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import prep, recommend as R, recommender as M
from marketlens.plans.oracle import fragment, sql_with
from marketlens.plans.q_prep import CLS_NUMERIC, cls_split, numeric_long_sql, onehot_long_sql, scale_sql
from marketlens.plans.q_prepare import reg_prepared
from marketlens.plans.registry import register, kept_result
from marketlens.schema import (CATEGORICAL_CANDIDATES, CATEGORICAL_COLUMNS, CLASSIFICATION_FEATURES, LOG_NUMERIC_CANDIDATES,
                               PRODUCT_COLUMNS, STAGE_FEATURE_SETS, STANDARD_NUMERIC_CANDIDATES)
from marketlens.plans.q_prepare import profile
from marketlens.session import materialize


@kept_result("recommender_run")
def run(spark, sf):
    return M.compare_recommenders(reg_prepared(spark, sf))


def _holdout_predictions(spark, sf, stage: str, model: str):
    data = materialize(M.prepared_targets(reg_prepared(spark, sf)))
    sm = M.fit_stage_model(data.filter(~F.col("is_test")), stage, STAGE_FEATURE_SETS[stage], model)
    return R.normalize_shares(sm.predict_raw(data.filter("is_test"), ["ID"]))


register("multi_output_linear", note="M11: Existing-customer OLS, normalised test predictions")(
    lambda spark, sf: _holdout_predictions(spark, sf, "Existing-customer", M.LINEAR))
register("multi_output_poly2", note="M12: Existing-customer degree-2 OLS, normalised test predictions")(
    lambda spark, sf: _holdout_predictions(spark, sf, "Existing-customer", M.POLY))


def _t6_sql() -> str:
    feats = STAGE_FEATURE_SETS["Existing-customer"]
    logs = [c for c in LOG_NUMERIC_CANDIDATES if c in feats]
    std = [c for c in STANDARD_NUMERIC_CANDIDATES if c in feats]
    cats = [c for c in CATEGORICAL_CANDIDATES if c in feats]
    consts, body = scale_sql("(SELECT * FROM reg_valid_split WHERE NOT is_test)", "reg_valid_split", logs + std, logs)
    fragment("stage_consts", consts, ("reg_valid_split",))
    return sql_with(numeric_long_sql(body, logs + std, "reg_valid_split a CROSS JOIN stage_consts k WHERE a.is_test")
                    + " UNION ALL " + onehot_long_sql("reg_valid_split", cats), "stage_consts")


def _t5_sql() -> str:
    _, body = scale_sql("cls_split", "cls_split", CLS_NUMERIC)
    return sql_with(numeric_long_sql(body, CLS_NUMERIC, "cls_split a CROSS JOIN cls_scale_consts k WHERE a.is_test")
                    + " UNION ALL " + onehot_long_sql("cls_split", CATEGORICAL_COLUMNS), "cls_scale_consts")


@register("stage_preprocessor", _t6_sql(), note="T6: Existing-customer log/plain/one-hot blocks fitted on train")
def q_stage_preprocessor(spark, sf):
    data = M.prepared_targets(reg_prepared(spark, sf))
    fitted = prep.fit_stage(data.filter(~F.col("is_test")), STAGE_FEATURE_SETS["Existing-customer"])
    return fitted.transform_long(data.filter("is_test"))


@register("classification_preprocessor", _t5_sql(), note="T5: median/scale numeric + mode/one-hot strings, by dtype")
def q_classification_preprocessor(spark, sf):
    d = cls_split(spark, sf)
    fitted = prep.fit_by_dtype(d.filter(~F.col("is_test")), CLASSIFICATION_FEATURES)
    return fitted.transform_long(d.filter("is_test"))


register("compare_recommenders", note="E7: 3 stages x 2 models summary")(lambda spark, sf: run(spark, sf).summary)
register("union_metrics", note="R2: stacked per-combination metric rows (the E7 summary)")(
    lambda spark, sf: run(spark, sf).summary.select("Business Model", "Regression Model", "Test R2",
                                                     "Recommendation Match Rate"))
register("run_recommendation", note="E9: final model prediction frame")(
    lambda spark, sf: run(spark, sf).final_predictions)
register("best_per_business_model", note="W4")(
    lambda spark, sf: R.best_per_group(run(spark, sf).summary, "Business Model",
                                       [F.col("Recommendation Match Rate").desc(), F.col("Test R2").desc(),
                                        "Regression Model"]))
register("melt_metrics", note="R1")(
    lambda spark, sf: R.melt_metrics(run(spark, sf).summary, ["Business Model", "Regression Model"],
                                     ["CV R2 Mean", "Test R2"]))


@register("recommender_diagnostics", note="E10: confusion counts, rates and distribution of the final model")
def q_recommender_diagnostics(spark, sf):
    return R.product_diagnostics(run(spark, sf).final_predictions)


@register("score_customers", note="M13: final model applied to every customer of the table")
def q_score_customers(spark, sf):
    r = run(spark, sf)
    return M.score_customers(profile(spark, sf), r)


register("spending_regression", note="M14: TotalSpending ~ Income, Age, Kidhome, Teenhome")(
    lambda spark, sf: M.spending_regression(reg_prepared(spark, sf)))


@register("score_customers_stream", note="M13 on Structured Streaming: customer files scored per micro-batch")
def q_score_customers_stream(spark, sf):
    from marketlens.sources import files
    from marketlens.streaming.scoring import fit_recommender, start_scoring_stream
    run_ = fit_recommender(reg_prepared(spark, sf))
    src = files.scratch_path(spark, "customers_in")
    profile(spark, sf).repartition(4).write.parquet(src)  # derived customer rows arriving as files
    sink, ckpt = files.scratch_path(spark, "scored"), files.scratch_path(spark, "scored_ckpt")
    query = start_scoring_stream(spark, src, run_, sink, ckpt, max_files_per_trigger=1)
    query.awaitTermination()
    return spark.read.parquet(sink)


register("cv_r2_mean_std", note="V6: mean and population std of the fold R2 per stage x model")(
    lambda spark, sf: run(spark, sf).summary.select("Business Model", "Regression Model", "CV R2 Mean", "CV R2 Std"))
