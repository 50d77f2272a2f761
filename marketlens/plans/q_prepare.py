"""Queries for sources, features, filters and data summaries (S, P, F, A5, A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import clean, features as P, stats
from marketlens.plans.oracle import nz_sum, sql_with
from marketlens.plans.registry import kept_result, register
from marketlens.schema import CLASSIFICATION_FEATURES, IDENTIFIER_COLUMNS, PRODUCT_COLUMNS, RAW_COLUMNS
from marketlens.sources import files
from marketlens.sources.profile import customer_profile
from marketlens.session import materialize


# --- shared Spark pipelines -------------------------------------------------
@kept_result("customer_profile")
def profile(spark, sf):
    """The derived customer table, from which every workflow starts.

    Written once as a reliable checkpoint under ``spark.checkpoint.dir`` (shared storage on a cluster);
    lineage to the star schema is cut there.  The ``build_customer_profile`` query itself always derives it afresh.
    """
    return materialize(customer_profile(spark, sf))


def cls_featured(spark, sf):
    """Classification ages customers at the table's latest enrolment year."""
    return P.add_project_features(profile(spark, sf), reference_year="max")


def clu_featured(spark, sf):
    """Clustering (like the recommender) ages them at a fixed year."""
    return P.add_project_features(profile(spark, sf))


def cls_clean(spark, sf):
    return clean.clean_classification(cls_featured(spark, sf))


def clu_clean(spark, sf):
    return clean.clean_clustering(clu_featured(spark, sf))


def reg_prepared(spark, sf):
    return P.prepare_regression_frame(profile(spark, sf))


# --- S1 ---------------------------------------------------------------------
@register("load_customers", sql_with("SELECT * FROM customer_profile", "customer_profile"))
def q_load_customers(spark, sf):
    """Round trip: the profile written as TSV to the shared scratch folder, read back by S1."""
    path = files.write_csv(profile(spark, sf), files.scratch_path(spark, "customers_tsv"), sep="\t")
    return files.load_customers(spark, path)


# --- S3 / S4 ------------------------------------------------------------------
def _null_profile_sql(source: str, cols, dep: str) -> str:
    selects = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS missing FROM {source}" for c in cols)
    return sql_with(f"SELECT * FROM ({selects}) WHERE missing > 0", dep)


register("null_profile", _null_profile_sql("customer_profile", RAW_COLUMNS, "customer_profile"))(
    lambda spark, sf: stats.null_profile(profile(spark, sf)))

CLEANED_COLUMNS = len(RAW_COLUMNS) + 6 - len(IDENTIFIER_COLUMNS)  # 30, as in the published summary


def _summary_sql() -> str:
    miss = ", ".join(f"CASE WHEN count_if({c} IS NULL) > 0 THEN '{c}:' || CAST(count_if({c} IS NULL) AS VARCHAR) END"
                     for c in CLASSIFICATION_FEATURES)
    return sql_with(
        "SELECT (SELECT CAST(count(*) AS BIGINT) FROM customer_profile) AS raw_rows,\n"
        f"  {len(RAW_COLUMNS)} AS raw_columns, CAST(count(*) AS BIGINT) AS cleaned_rows, {CLEANED_COLUMNS} AS cleaned_columns,\n"
        "  (SELECT CAST(count(*) AS BIGINT) FROM customer_profile) - CAST(count(*) AS BIGINT) AS removed_outlier_rows,\n"
        f"  {len(CLASSIFICATION_FEATURES)} AS feature_count,\n"
        "  CAST(count_if(Response = 0) AS BIGINT) AS target_count_0, CAST(count_if(Response = 1) AS BIGINT) AS target_count_1,\n"
        "  round_even(count_if(Response = 0) / count(*), 4) AS target_rate_0,\n"
        "  round_even(count_if(Response = 1) / count(*), 4) AS target_rate_1,\n"
        f"  concat_ws(', ', {miss}) AS missing_values_used_for_imputation,\n"
        f"  '{', '.join(CLASSIFICATION_FEATURES)}' AS features\n"
        "FROM cls_clean", "cls_clean")


@register("dataset_summary", _summary_sql())
def q_dataset_summary(spark, sf):
    raw = profile(spark, sf)
    cleaned = clean.clean_classification(P.add_project_features(raw, reference_year="max"))
    return stats.dataset_summary(raw, cleaned, CLASSIFICATION_FEATURES, cleaned_columns=CLEANED_COLUMNS)


@register("dataset_summary_json", _summary_sql(), note="S6: the summary written as a JSON document and read again")
def q_dataset_summary_json(spark, sf):
    summary = q_dataset_summary(spark, sf)
    path = files.write_json_rows(summary.coalesce(1), files.scratch_path(spark, "summary_json"))
    return spark.read.schema(summary.schema).json(path)


# --- P1-P12 -------------------------------------------------------------------
register("parse_enrollment_date", sql_with("SELECT ID, Dt_Customer FROM _dated", "_dated"))(
    lambda spark, sf: P.parse_enrollment_date(profile(spark, sf)).select("ID", "Dt_Customer"))
register("customer_tenure", sql_with("SELECT ID, CustomerTenure FROM features", "features"))(
    lambda spark, sf: cls_featured(spark, sf).select("ID", "CustomerTenure"))
register("customer_age", sql_with("SELECT ID, Age FROM features", "features"))(
    lambda spark, sf: P.customer_age(profile(spark, sf)).select("ID", "Age"))
register("customer_age_max_year", sql_with(
    "SELECT ID, CAST((SELECT max(year(Dt_Customer)) FROM _dated) - Year_Birth AS INTEGER) AS Age FROM _dated", "_dated"))(
    lambda spark, sf: P.customer_age(P.parse_enrollment_date(profile(spark, sf)), "max").select("ID", "Age"))
register("total_children", sql_with("SELECT ID, TotalChildren FROM features", "features"))(
    lambda spark, sf: P.total_children(profile(spark, sf)).select("ID", "TotalChildren"))
register("total_spending", sql_with(
    "SELECT ID, TotalSpending, TotalPurchases, CampaignAcceptedTotal FROM features", "features"))(
    lambda spark, sf: P.add_totals(profile(spark, sf)).select("ID", "TotalSpending", "TotalPurchases",
                                                              "CampaignAcceptedTotal"))
register("group_rare_status", sql_with("SELECT ID, Marital_Status FROM features", "features"))(
    lambda spark, sf: P.group_rare_status(profile(spark, sf)).select("ID", "Marital_Status"))
register("fill_mode_category", sql_with("SELECT ID, Marital_Status FROM reg_prepared", "reg_prepared"))(
    lambda spark, sf: reg_prepared(spark, sf).select("ID", "Marital_Status"))
register("has_partner", sql_with("SELECT ID, HasPartner FROM reg_prepared", "reg_prepared"))(
    lambda spark, sf: reg_prepared(spark, sf).select("ID", "HasPartner"))
register("feature_matrix", sql_with(
    f"SELECT ID, {', '.join(CLASSIFICATION_FEATURES)}, CAST(Response AS INTEGER) AS Response FROM cls_clean",
    "cls_clean"))(lambda spark, sf: P.feature_matrix(cls_clean(spark, sf)))
register("stage_feature_matrix", sql_with(
    f"SELECT ID, {', '.join(P.stage_feature_columns())} FROM reg_prepared", "reg_prepared"))(
    lambda spark, sf: P.stage_feature_matrix(reg_prepared(spark, sf)))

_TOTAL = nz_sum(PRODUCT_COLUMNS)
fragment_shares = ("SELECT ID, " + ", ".join(f"{c} / {_TOTAL} AS {c}" for c in PRODUCT_COLUMNS)
                   + f" FROM reg_prepared WHERE {_TOTAL} > 0")
register("spending_share_target", sql_with(fragment_shares, "reg_prepared"))(
    lambda spark, sf: P.spending_share_target(reg_prepared(spark, sf)))
register("drop_identifiers", sql_with(
    "SELECT * EXCLUDE (Year_Birth, Dt_Customer, Z_CostContact, Z_Revenue) FROM cls_clean", "cls_clean"))(
    lambda spark, sf: P.drop_identifiers(cls_clean(spark, sf)))

# --- F1-F4 ----------------------------------------------------------------------
register("clean_classification", sql_with("SELECT * FROM cls_clean", "cls_clean"))(cls_clean)
register("clean_clustering", sql_with("SELECT * FROM clu_clean", "clu_clean"))(clu_clean)
register("clean_regression", sql_with("SELECT * FROM reg_prepared", "reg_prepared"))(reg_prepared)


@register("removed_rows", sql_with(
    "SELECT 'classification' AS workflow, CAST(count(*) AS BIGINT) AS rows_before, "
    "(SELECT CAST(count(*) AS BIGINT) FROM cls_clean) AS rows_after, "
    "CAST(count(*) AS BIGINT) - (SELECT CAST(count(*) AS BIGINT) FROM cls_clean) AS removed_rows FROM features "
    "UNION ALL SELECT 'clustering', CAST(count(*) AS BIGINT), (SELECT CAST(count(*) AS BIGINT) FROM clu_clean), "
    "CAST(count(*) AS BIGINT) - (SELECT CAST(count(*) AS BIGINT) FROM clu_clean) FROM features "
    "UNION ALL SELECT 'regression', CAST(count(*) AS BIGINT), (SELECT CAST(count(*) AS BIGINT) FROM reg_prepared), "
    "CAST(count(*) AS BIGINT) - (SELECT CAST(count(*) AS BIGINT) FROM reg_prepared) FROM customer_profile",
    "cls_clean", "clu_clean", "reg_prepared"))
def q_removed_rows(spark, sf):
    raw = profile(spark, sf)
    age = F.lit(P.FIXTURE_REFERENCE_YEAR) - F.col("Year_Birth")
    reg_keep = age.between(18, 100) & (F.col("Income").isNull() | (F.col("Income") <= 300000))
    parts = [clean.removed_rows(cls_featured(spark, sf), clean.keep_classification()).select(F.lit("classification").alias("workflow"), "*"),
             clean.removed_rows(clu_featured(spark, sf), clean.keep_clustering()).select(F.lit("clustering").alias("workflow"), "*"),
             clean.removed_rows(raw, reg_keep).select(F.lit("regression").alias("workflow"), "*")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- A5 / A10 -----------------------------------------------------------------
register("target_distribution", sql_with(
    "SELECT CAST(Response AS INTEGER) AS Response, CAST(count(*) AS BIGINT) AS count, "
    "round_even(count(*) / (SELECT count(*) FROM cls_clean), 4) AS rate FROM cls_clean GROUP BY 1", "cls_clean"))(
    lambda spark, sf: stats.target_distribution(cls_clean(spark, sf)))


def _hist_sql(cols, bins=20) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS feature, CAST(g.bin AS INTEGER) AS bin, r.lo + g.bin * ((r.hi - r.lo) / {bins}) AS bin_start, "
            f"r.lo + (g.bin + 1) * ((r.hi - r.lo) / {bins}) AS bin_end, "
            f"CAST(coalesce(h.n, 0) AS BIGINT) AS count FROM range({bins}) g(bin) "
            f"CROSS JOIN (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM cls_clean) r "
            f"LEFT JOIN (SELECT CAST(least(floor(coalesce((CAST({c} AS DOUBLE) - r2.lo) / nullif((r2.hi - r2.lo) / {bins}, 0), 0)), {bins - 1}) AS INTEGER) AS b, "
            f"count(*) AS n FROM cls_clean CROSS JOIN (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM cls_clean) r2 "
            f"WHERE {c} IS NOT NULL GROUP BY 1) h ON h.b = g.bin")
    return sql_with(" UNION ALL ".join(parts), "cls_clean")


register("histogram_20", _hist_sql(["Age", "Income"]))(
    lambda spark, sf: stats.histogram(cls_clean(spark, sf), ["Age", "Income"], 20))
