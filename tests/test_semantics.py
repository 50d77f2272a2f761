"""Hand fixtures of FIXTURES.md section 5 and published golden figures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import classify as C, features as P, prep, recommend as R, segment as G
from marketlens.schema import (PERSONA_HIGH_VALUE, PERSONA_LOW, PERSONA_MIDDLE, PERSONA_RESPONSIVE,
                               PRODUCT_COLUMNS, PROFILE_BASE_COLUMNS)


def test_metrics_from_published_confusion_counts(spark):
    # fixed values: TN / FP / FN / TP of the balanced logistic holdout and its published scores
    c = spark.createDataFrame([(51, 65, 16, 316)], "tp long, fp long, fn long, tn long")
    m = C.metrics_from_counts(c).first()
    assert m["precision"] == pytest.approx(0.4396551724137931, abs=1e-12)
    assert m["recall"] == pytest.approx(0.7611940298507462, abs=1e-12)
    assert m["f1"] == pytest.approx(0.5573770491803278, abs=1e-12)
    assert m["accuracy"] == pytest.approx(367 / 448, abs=1e-12)


def test_classification_report_from_counts(spark):
    rows = [(0, 0)] * 316 + [(0, 1)] * 65 + [(1, 0)] * 16 + [(1, 1)] * 51
    pred = spark.createDataFrame([("m", y, p) for y, p in rows], "model string, label int, prediction int")
    rep = {r["label"]: r for r in C.classification_report(pred).collect()}
    assert rep["Response"]["support"] == 67 and rep["No Response"]["support"] == 381
    assert rep["No Response"]["precision"] == pytest.approx(316 / 332)
    assert rep["macro avg"]["recall"] == pytest.approx((316 / 381 + 51 / 67) / 2)
    assert rep["weighted avg"]["f1_score"] == pytest.approx(
        (2 * 316 / (2 * 316 + 16 + 65) * 381 + 2 * 51 / (2 * 51 + 65 + 16) * 67) / 448)


def test_zero_division_majority_metrics(spark):
    pred = spark.createDataFrame([("m", -1, 1, 0, 0.0), ("m", -1, 0, 0, 0.0)],
                                 "model string, fold int, label int, prediction int, score double")
    m = C.binary_metrics(pred).first()
    assert (m["precision"], m["recall"], m["f1"]) == (0.0, 0.0, 0.0)
    assert C.roc_auc(pred).first()["roc_auc"] == 0.5


def test_personas_on_published_profile(spark):
    # fixed values: the four published cluster profile rows (k = 4)
    rows = [
        (0, 993, 34269.04, 42.32, 1.22, 314.38, 49.25, 92.14, 7.56, 0.08, 6.4, 0.085),
        (1, 451, 53036.27, 48.48, 1.35, 473.11, 48.31, 666.34, 21.03, 0.25, 6.74, 0.164),
        (2, 223, 81401.3, 44.48, 0.2, 359.91, 49.28, 1644.1, 21.6, 1.84, 3.17, 0.507),
        (3, 569, 70161.24, 47.52, 0.46, 325.52, 49.45, 1048.04, 20.11, 0.11, 3.15, 0.111),
    ]
    cols = ["Cluster", "CustomerCount"] + [f"{c}_mean" for c in PROFILE_BASE_COLUMNS] + ["Response_Rate"]
    prof = spark.createDataFrame(rows, cols)
    got = {r["Cluster"]: r["Persona_Label"] for r in G.persona_labels(prof).collect()}
    assert got == {0: PERSONA_LOW, 1: PERSONA_MIDDLE, 2: PERSONA_RESPONSIVE, 3: PERSONA_HIGH_VALUE}


def test_normalize_all_negative_row_and_zero_prior(spark):
    df = spark.createDataFrame([(1, *([-1.0] * 6)), (2, 1.0, 3.0, 0.0, 0.0, 0.0, -2.0)], ["ID", *PRODUCT_COLUMNS])
    out = {r["ID"]: [r[c] for c in PRODUCT_COLUMNS] for r in R.normalize_shares(df).collect()}
    assert out[1] == [0.0] * 6
    assert out[2] == pytest.approx([0.25, 0.75, 0, 0, 0, 0])
    prior = spark.createDataFrame([(0.5, None, 0.1, 0.1, 0.1, 0.2)],
                                  ", ".join(f"{R.PRIOR_PREFIX}{c} double" for c in PRODUCT_COLUMNS))
    rel = R.relative_preference(R.normalize_shares(df), prior).filter("ID = 2").first()
    assert rel["MntFruits"] == 0.0 and rel["MntWines"] == pytest.approx(0.5)


def test_ties_follow_product_order(spark):
    df = spark.createDataFrame([(1, 0.2, 0.2, 0.1, 0.2, 0.1, 0.2)], ["ID", *PRODUCT_COLUMNS])
    r = R.add_banner(R.with_top1(df, "top")).first()
    assert r["top"] == "MntWines"
    assert r["Banner_Ad_Order"] == "MntWines > MntFruits > MntFishProducts > MntGoldProds > MntMeatProducts > MntSweetProducts"
    assert r["Banner_Ad_Scores"].startswith("MntWines:0.200 | MntFruits:0.200")


def test_mode_tie_smallest_and_even_median(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (2, "a", 2.0), (3, "b", 3.0), (4, "a", 4.0), (5, None, None)],
                               "ID long, Marital_Status string, x double")
    filled = {r["ID"]: r["Marital_Status"] for r in P.fill_mode_category(df).collect()}
    assert filled[5] == "a"
    fitted = prep.fit_preprocessor(df, numeric=["x"], categorical=["Marital_Status"])
    assert fitted.medians["x"] == 2.5
    assert fitted.modes["Marital_Status"] == "a"


def test_unseen_category_and_constant_column(spark):
    train = spark.createDataFrame([(1, "a", 5.0), (2, "b", 5.0)], "ID long, c string, k double")
    test = spark.createDataFrame([(3, "z", 5.0)], "ID long, c string, k double")
    fitted = prep.fit_preprocessor(train, numeric=["k"], categorical=["c"])
    row = fitted.transform_columns(test).first()
    assert row["k"] == 0.0 and row["c_a"] == 0.0 and row["c_b"] == 0.0
    assert fitted.scales["k"] == 1.0


def test_ddof0_scaling(spark):
    train = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4])], "ID long, x double")
    f = prep.fit_preprocessor(train, numeric=["x"])
    assert f.scales["x"] == pytest.approx(np.std([1, 2, 3, 4]))


def test_bad_date_kept_by_classification_dropped_by_clustering(spark):
    from marketlens.operators import clean
    rows = [(1, 1980, "Graduation", "Single", 50000.0, 0, 0, "31-13-2000"),
            (2, 1980, "Graduation", "Single", 50000.0, 0, 1, "01-02-2000")]
    df = spark.createDataFrame(rows, "ID long, Year_Birth int, Education string, Marital_Status string, "
                                     "Income double, Kidhome int, Teenhome int, Dt_Customer string")
    for c in PRODUCT_COLUMNS + ["NumDealsPurchases", "NumWebPurchases", "NumCatalogPurchases", "NumStorePurchases",
                                "AcceptedCmp1", "AcceptedCmp2", "AcceptedCmp3", "AcceptedCmp4", "AcceptedCmp5"]:
        df = df.withColumn(c, F.lit(1))
    feats = P.add_project_features(df)
    assert {r["ID"] for r in clean.clean_classification(feats).collect()} == {1, 2}
    assert {r["ID"] for r in clean.clean_clustering(feats).collect()} == {2}
    assert feats.filter("ID = 1").first()["CustomerTenure"] is None


def test_row_sums_skip_nulls_but_children_propagate(spark):
    names = ["ID", "Kidhome", "Teenhome", *PRODUCT_COLUMNS, "NumDealsPurchases", "NumWebPurchases",
             "NumCatalogPurchases", "NumStorePurchases", "AcceptedCmp1", "AcceptedCmp2",
             "AcceptedCmp3", "AcceptedCmp4", "AcceptedCmp5"]
    df = spark.createDataFrame([(1, None, 2, *([None] + [1] * 5), 1, None, 1, 1, *([1] * 5))],
                               ", ".join(f"{n} long" for n in names))
    r = P.add_totals(P.total_children(df)).first()
    assert r["TotalChildren"] is None and r["TotalSpending"] == 5 and r["TotalPurchases"] == 3


def test_reference_ratio_shares_sum_to_one(spark):
    from conftest import SF_SMALL
    from marketlens.plans.q_prepare import reg_prepared
    shares = P.spending_share_target(reg_prepared(spark, SF_SMALL))
    s = shares.select(sum(F.col(c) for c in PRODUCT_COLUMNS).alias("s")).toPandas()["s"]
    assert np.allclose(s, 1.0)
