"""Preprocessing queries (T1-T4, T7, T8) fitted on the training rows, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import features as P, prep, split as S
from marketlens.plans.oracle import fragment, sql_with
from marketlens.plans.q_prepare import cls_clean, clu_clean, reg_prepared
from marketlens.plans.registry import register
from marketlens.schema import CATEGORICAL_COLUMNS, CLASSIFICATION_FEATURES, CLUSTER_FEATURES, STAGE_FEATURE_SETS

CLS_NUMERIC = [c for c in CLASSIFICATION_FEATURES if c not in CATEGORICAL_COLUMNS]
ZS = repr(prep.ZERO_SCALE)


def cls_split(spark, sf):
    """Classification feature matrix with the stratified 80/20 test flag."""
    return S.split_flag(P.feature_matrix(cls_clean(spark, sf)), strata=["Response"])


fragment("cls_fm", "SELECT ID, " + ", ".join(CLASSIFICATION_FEATURES) + ", CAST(Response AS INTEGER) AS Response "
         "FROM cls_clean", ("cls_clean",))
fragment("cls_split", S.split_sql("cls_fm", strata=["Response"]), ("cls_fm",))


def scale_sql(source_train: str, source_apply: str, cols, log_cols=()) -> tuple[str, str]:
    """(constants CTE body, transformed select) for median -> [log1p] -> ddof-0 scale."""
    meds = ", ".join(f"median(CAST({c} AS DOUBLE)) AS med_{c}" for c in cols)
    def imp(c, t=""):
        e = f"coalesce(CAST({t}{c} AS DOUBLE), m.med_{c})"
        return f"ln(1 + {e})" if c in log_cols else e
    mom = ", ".join(f"avg({imp(c)}) AS mu_{c}, stddev_pop({imp(c)}) AS sd_{c}" for c in cols)
    consts = (f"SELECT m.*, {mom} FROM {source_train} CROSS JOIN (SELECT {meds} FROM {source_train}) m "
              f"GROUP BY ALL")
    body = ", ".join(f"({imp(c, 'a.').replace('m.med_', 'k.med_')} - k.mu_{c}) / "
                     f"(CASE WHEN k.sd_{c} IS NULL OR k.sd_{c} < {ZS} THEN 1 ELSE k.sd_{c} END) AS {c}"
                     for c in cols)
    return consts, body


# --- T1 / T2: fitted constants as tables ---------------------------------------------------
@register("impute_median", sql_with(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, median(CAST({c} AS DOUBLE)) AS median FROM cls_split WHERE NOT is_test"
                       for c in CLS_NUMERIC), "cls_split"))
def q_impute_median(spark, sf):
    train = cls_split(spark, sf).filter(~F.col("is_test"))
    medians = prep.fit_preprocessor(train, numeric=CLS_NUMERIC).medians
    return spark.createDataFrame([(c, medians[c]) for c in CLS_NUMERIC], "feature string, median double")


@register("impute_most_frequent", sql_with(
    " UNION ALL ".join(f"(SELECT '{c}' AS feature, {c} AS mode FROM cls_split WHERE NOT is_test AND {c} IS NOT NULL "
                       f"GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in CATEGORICAL_COLUMNS), "cls_split"))
def q_impute_most_frequent(spark, sf):
    train = cls_split(spark, sf).filter(~F.col("is_test"))
    wide = train.agg(*[F.mode(c, True).alias(c) for c in CATEGORICAL_COLUMNS])
    return wide.unpivot([], CATEGORICAL_COLUMNS, "feature", "mode")


# --- T3: scaled numeric columns of the test rows (fit on train) ---------------------------------
_c, _b = scale_sql("(SELECT * FROM cls_split WHERE NOT is_test)", "cls_split", CLS_NUMERIC)
fragment("cls_scale_consts", _c, ("cls_split",))
register("standard_scale", sql_with(
    f"SELECT a.ID, {_b} FROM cls_split a CROSS JOIN cls_scale_consts k WHERE a.is_test", "cls_scale_consts"))(
    lambda spark, sf: (lambda d: prep.fit_preprocessor(d.filter(~F.col("is_test")), numeric=CLS_NUMERIC)
                       .transform_columns(d.filter("is_test")))(cls_split(spark, sf)))


# --- T4: dummies of the test rows (levels and modes from train), one row per customer and level -------------
def onehot_long_sql(split: str, cols) -> str:
    """(ID, feature, value) of the test rows of ``split`` for every level its train rows have."""
    return " UNION ALL ".join(
        f"SELECT a.ID, '{c}_' || l.lv AS feature, CAST(coalesce(coalesce(a.{c}, md.mode) = l.lv, false) AS DOUBLE) AS value "
        f"FROM (SELECT * FROM {split} WHERE is_test) a "
        f"CROSS JOIN (SELECT DISTINCT {c} AS lv FROM {split} WHERE NOT is_test AND {c} IS NOT NULL) l "
        f"CROSS JOIN (SELECT {c} AS mode FROM {split} WHERE NOT is_test AND {c} IS NOT NULL "
        f"GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) md" for c in cols)


def numeric_long_sql(body: str, cols, source: str) -> str:
    """(ID, feature, value) from the scaled columns of ``body``."""
    return " UNION ALL ".join(f"SELECT ID, '{c}' AS feature, {c} AS value FROM (SELECT a.ID, {body} FROM {source}) s" for c in cols)


def _onehot_spark(spark, sf):
    d = cls_split(spark, sf)
    fitted = prep.fit_preprocessor(d.filter(~F.col("is_test")), categorical=CATEGORICAL_COLUMNS)
    return fitted.transform_long(d.filter("is_test"))


register("one_hot", sql_with(onehot_long_sql("cls_split", CATEGORICAL_COLUMNS), "cls_split"))(_onehot_spark)


# --- T8: 13 clustering features, median + scale fitted on all cleaned rows ------------------------------
_c8, _b8 = scale_sql("clu_clean", "clu_clean", CLUSTER_FEATURES)
fragment("clu_scale_consts", _c8, ("clu_clean",))
fragment("clu_scaled", f"SELECT a.ID, {_b8} FROM clu_clean a CROSS JOIN clu_scale_consts k", ("clu_scale_consts",))
register("clustering_features", sql_with("SELECT * FROM clu_scaled", "clu_scaled"))(
    lambda spark, sf: (lambda d: prep.fit_preprocessor(d, numeric=CLUSTER_FEATURES).transform_columns(d))(
        clu_clean(spark, sf)))

# --- T7: degree-2 terms of the New-user numeric block (log Income, Age, Kidhome, Teenhome) -----------------
NEW_USER = STAGE_FEATURE_SETS["New-user"]
_LOG = [c for c in prep.LOG_NUMERIC_CANDIDATES if c in NEW_USER]
_STD = [c for c in prep.STANDARD_NUMERIC_CANDIDATES if c in NEW_USER]
_NUM = _LOG + _STD
_TOT = " + ".join(f"coalesce({c}, 0)" for c in ["MntWines", "MntFruits", "MntMeatProducts", "MntFishProducts",
                                                  "MntSweetProducts", "MntGoldProds"])
fragment("reg_valid_split", S.split_sql(f"(SELECT * FROM reg_prepared WHERE {_TOT} > 0)"), ("reg_prepared",))
_c7, _b7 = scale_sql("(SELECT * FROM reg_valid_split WHERE NOT is_test)", "reg_valid_split", _NUM, _LOG)
fragment("poly_consts", _c7, ("reg_valid_split",))
fragment("poly_base", f"SELECT a.ID, {_b7} FROM reg_valid_split a CROSS JOIN poly_consts k WHERE a.is_test",
         ("poly_consts",))


def _poly_sql() -> str:
    terms = []
    for j, b in enumerate(_NUM):
        terms.append(f'{b} AS "{b}"')
        terms += [f'{_NUM[i]} * {b} AS "{_NUM[i]}*{b}"' for i in range(j + 1)]
    return sql_with(f"SELECT ID, {', '.join(terms)} FROM poly_base", "poly_base")


@register("polynomial_2", _poly_sql())
def q_polynomial_2(spark, sf):
    d = S.split_flag(P.spending_share_target(reg_prepared(spark, sf), keep=NEW_USER), 0.2)
    fitted = prep.fit_preprocessor(d.filter(~F.col("is_test")), numeric=_STD, log_numeric=_LOG)
    scaled = fitted.transform_columns(d.filter("is_test"))
    return prep.poly2_columns(scaled, _NUM)
