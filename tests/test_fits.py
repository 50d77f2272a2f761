"""Fitted models against the conditions that define them (no second library needed)."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from marketlens.functions.rowexpr import row_sum_skip_nulls
from marketlens.operators import classify as C, recommend as R, recommender as M, segment as G
from marketlens.operators.linreg import fit_least_squares, poly2_numpy
from marketlens.plans.q_classify import holdout_vectors
from marketlens.plans.q_prepare import profile, reg_prepared
from marketlens.schema import PRODUCT_COLUMNS, STAGE_FEATURE_SETS
from marketlens.sources import files

from conftest import SF_SMALL


@pytest.mark.parametrize("balanced", [False, True])
def test_logistic_gradient_vanishes(spark, balanced):
    train, _ = holdout_vectors(spark, SF_SMALL)
    model = C.fit_logistic(train, balanced)
    rows = train.select(vector_to_array("features").alias("x"), C.LABEL).collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r[C.LABEL] for r in rows], dtype=float)
    n = len(y)
    w = np.ones(n)
    if balanced:
        w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    p = 1 / (1 + np.exp(-(x @ model.coefficients + model.intercept)))
    gradient = x.T @ (w * (p - y)) / w.sum() + model.coefficients / n
    assert np.abs(gradient).max() < 1e-8 and abs((w * (p - y)).sum() / w.sum()) < 1e-8


def test_tree_leaves_hold_enough_rows_and_their_shares(spark):
    train, _ = holdout_vectors(spark, SF_SMALL)
    got = C.predict_tree(train, train).groupBy("score").agg(F.count("*").alias("n"), F.avg(C.LABEL).alias("y"), F.max("prediction").alias("p")).collect()
    assert all(r["n"] >= 20 for r in got) and len(got) <= 32
    y = [r for r in train.groupBy(C.LABEL).count().collect()]
    n = {r[C.LABEL]: r["count"] for r in y}
    for r in got:  # balanced share of the leaf
        one, zero = r["y"] / n[1], (1 - r["y"]) / n[0]
        assert r["score"] == pytest.approx(one / (one + zero), abs=1e-9) and r["p"] == int(r["score"] > 0.5)


@pytest.mark.parametrize("degree2", [False, True])
def test_least_squares_residuals_are_orthogonal(spark, degree2):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 4)), rng.normal(size=(200, 2))
    df = spark.createDataFrame([(i, x[i].tolist(), *y[i].tolist()) for i in range(200)], "ID long, f array<double>, a double, b double")
    model = fit_least_squares(df, "f", ["a", "b"], dim=4, degree2=degree2)
    pred = np.array([[r["a"], r["b"]] for r in model.predict(df, "f", ["ID"]).orderBy("ID").collect()])
    design = poly2_numpy(x) if degree2 else x
    assert np.abs(design.T @ (pred - y)).max() < 1e-7 and np.abs((pred - y).sum(axis=0)).max() < 1e-7


def test_kmeans_is_a_fixed_point(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, size=(60, 3)) for c in (-3, 0, 3)])
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "ID long, f array<double>").select("ID", array_to_vector("f").alias("features"))
    model = G.fit_kmeans(df, 3, n_init=3)
    centres = np.array(model.clusterCenters())
    label = np.array([r["Cluster"] for r in model.transform(df).orderBy("ID").collect()])
    assert (((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) == label).all()
    assert np.abs(np.array([x[label == c].mean(axis=0) for c in range(3)]) - centres).max() < 1e-4
    cost = sum(((x[label == c] - x[label == c].mean(axis=0)) ** 2).sum() for c in range(3))
    table, _ = G.k_selection(df, [2, 3], n_init=2)
    best = {r["k"]: r for r in table.collect()}
    assert best[3]["inertia"] == pytest.approx(cost, rel=1e-6) and best[3]["silhouette_score"] > best[2]["silhouette_score"]


def test_inertia_far_from_the_origin(spark):
    x = np.random.default_rng(3).normal(size=(50, 2)) + 1e8
    df = spark.createDataFrame([(i, x[i].tolist(), i % 2) for i in range(50)], "ID long, features array<double>, Cluster int")
    want = sum(((x[c::2] - x[c::2].mean(axis=0)) ** 2).sum() for c in range(2))
    assert G.inertia(df).first()[0] == pytest.approx(want, rel=1e-6)


def test_pca_directions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) * [5, 3, 1, 1, 1]
    x = (x - x.mean(axis=0)) @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)], "ID long, f array<double>").select("ID", array_to_vector("f").alias("features"))
    out, ratios = G.pca_2d(df)
    pc = np.array([[r["PC1"], r["PC2"]] for r in out.orderBy("ID").collect()])
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(pc.var(axis=0, ddof=1), values[:2]) and abs(np.corrcoef(pc.T)[0, 1]) < 1e-9
    assert ratios == pytest.approx((values[:2] / values.sum()).tolist())


def test_scoring_repeats_the_linear_model(spark):
    """M13 against plain arithmetic with the fitted constants, and without joins or exchanges."""
    data = M.prepared_targets(reg_prepared(spark, SF_SMALL)).cache()
    train = data.filter(~F.col("is_test"))
    stage = "Existing-customer"
    model = M.fit_stage_model(train, stage, STAGE_FEATURE_SETS[stage], M.LINEAR)
    run = M.RecommendationRun(None, (stage, M.LINEAR), None, {(stage, M.LINEAR): model}, R.fitted_prior(train), None, "Married")
    scored = M.score_customers(profile(spark, SF_SMALL), run)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    prior = R.product_prior(train).first()
    x = {r["ID"]: np.array([r[c] for c in model.pre.output_names()]) for r in
         model.pre.transform_columns(M.P.prepare_regression_frame(profile(spark, SF_SMALL), fill_status="Married")).collect()}
    for r in scored.collect():
        raw = np.maximum(x[r["ID"]] @ model.linear.coef + model.linear.intercept, 0)
        share = raw / raw.sum() if raw.sum() else raw
        for j, c in enumerate(PRODUCT_COLUMNS):
            assert r["PredictedRatio_" + c] == pytest.approx(share[j], abs=1e-9)
            assert r["RecommendationScore_" + c] == pytest.approx(share[j] / prior["prior_" + c], abs=1e-8)


def test_prediction_frame_has_one_join(spark):
    d = M.prepared_targets(reg_prepared(spark, SF_SMALL)).select("ID", *PRODUCT_COLUMNS)
    d = spark.createDataFrame(d.collect(), d.schema)
    plan = R.prediction_frame(d, R.normalize_shares(d), R.fitted_prior(d))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") + plan.count("Join Cross") <= 2  # the key, and the one-row prior


def test_results_are_kept_by_the_state_of_the_files(spark, tmp_path):
    from marketlens.plans.registry import forget_results, kept_result
    calls = []
    kept = kept_result("probe")(lambda s, sf: calls.append(sf) or len(calls))
    folder = str(tmp_path)
    spark.range(3).write.parquet(f"{folder}/labels.parquet")
    assert kept(spark, folder) == kept(spark, folder) == 1
    spark.range(30).write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    assert kept(spark, folder) == 2
    forget_results()
    assert kept(spark, folder) == 3


def test_json_documents(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 3, None)], "model string, n int, x double")
    path = files.write_json_documents(df, files.scratch_path(spark, "documents"), "model")
    rows = {r["model"]: r["value"] for r in spark.read.text(path).collect()}
    assert rows == {"a": '{"n":1,"x":2.0}', "b": '{"n":3}'}
    assert row_sum_skip_nulls(["n", "x"]) is not None
