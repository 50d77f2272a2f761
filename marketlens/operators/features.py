"""Feature engineering on the wide customer table (narrow projections).

Table-wide constants (latest enrolment date, the marital-status mode) are
one-row aggregates joined back with an explicit broadcast: their size is one
row by construction, so the broadcast never grows with the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.rowexpr import row_sum_skip_nulls
from marketlens.schema import (CAMPAIGN_COLUMNS, CLASSIFICATION_FEATURES, IDENTIFIER_COLUMNS,
                               PARTNER_STATUS, PRODUCT_COLUMNS, PURCHASE_COLUMNS,
                               RARE_MARITAL_STATUS, STAGE_FEATURE_SETS, existing, require_columns)

DATE_PATTERN = "d-M-yyyy"  # day-first, one or two digit day and month
FIXTURE_REFERENCE_YEAR = 2001  # our tables end in 2001 (FIXTURES.md section 2)


def parse_enrollment_date(df: DataFrame, col: str = "Dt_Customer", pattern: str = DATE_PATTERN) -> DataFrame:
    """Day-first date string -> DATE; unparseable -> NULL (never an error)."""
    return df.withColumn(col, F.try_to_timestamp(F.col(col), F.lit(pattern)).cast("date"))


def customer_tenure(df: DataFrame, date_col: str = "Dt_Customer") -> DataFrame:
    """Days from each enrolment to the table's latest enrolment."""
    latest = df.agg(F.max(date_col).alias("_ref_date"))
    return (df.crossJoin(F.broadcast(latest))
            .withColumn("CustomerTenure", F.datediff("_ref_date", date_col))
            .drop("_ref_date"))


def customer_age(df: DataFrame, reference_year: int | str = FIXTURE_REFERENCE_YEAR,
                 date_col: str = "Dt_Customer") -> DataFrame:
    """Reference year minus birth year; ``"max"`` = latest enrolment year."""
    if reference_year == "max":
        ref = df.agg(F.max(F.year(date_col)).alias("_ref_year"))
        return (df.crossJoin(F.broadcast(ref))
                .withColumn("Age", F.col("_ref_year") - F.col("Year_Birth")).drop("_ref_year"))
    return df.withColumn("Age", (F.lit(int(reference_year)) - F.col("Year_Birth")).cast("int"))


def total_children(df: DataFrame) -> DataFrame:
    """Kidhome + Teenhome, NULL if either is NULL."""
    return df.withColumn("TotalChildren", F.col("Kidhome") + F.col("Teenhome"))


def add_totals(df: DataFrame) -> DataFrame:
    """P5: spend / purchase / past-campaign totals; NULL cells count as 0.

    ``Response`` is never part of ``CampaignAcceptedTotal``.
    """
    return (df.withColumn("TotalSpending", row_sum_skip_nulls(PRODUCT_COLUMNS))
              .withColumn("TotalPurchases", row_sum_skip_nulls(PURCHASE_COLUMNS))
              .withColumn("CampaignAcceptedTotal", row_sum_skip_nulls(CAMPAIGN_COLUMNS)))


def group_rare_status(df: DataFrame, col: str = "Marital_Status") -> DataFrame:
    """Rare marital statuses become ``Other``; NULL stays NULL."""
    return df.withColumn(col, F.when(F.col(col).isin(*RARE_MARITAL_STATUS), F.lit("Other"))
                         .otherwise(F.col(col)))


def add_project_features(df: DataFrame, reference_year: int | str = FIXTURE_REFERENCE_YEAR,
                         pattern: str = DATE_PATTERN) -> DataFrame:
    """P1-P6 in one projection (plus one broadcast one-row aggregate)."""
    require_columns(df, ["Dt_Customer", "Year_Birth", "Kidhome", "Teenhome", "Marital_Status"])
    out = parse_enrollment_date(df, pattern=pattern)
    out = customer_tenure(out)
    out = customer_age(out, reference_year)
    out = total_children(out)
    out = add_totals(out)
    return group_rare_status(out)


def mode_category(df: DataFrame, col: str = "Marital_Status", empty_value: str = "Other") -> str:
    """The value that P7 fills in, as a fitted constant (for rows that come later)."""
    return df.agg(F.coalesce(F.mode(col, True), F.lit(empty_value)).alias("m")).first()["m"]


def fill_mode_category(df: DataFrame, col: str = "Marital_Status", empty_value: str = "Other",
                       value: str | None = None) -> DataFrame:
    """Fill NULL with ``value``, by default the table's most frequent value (ties -> smallest)."""
    if value is not None:
        return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))
    mode = df.agg(F.coalesce(F.mode(col, True), F.lit(empty_value)).alias("_mode"))
    return (df.crossJoin(F.broadcast(mode))
            .withColumn(col, F.coalesce(F.col(col), F.col("_mode"))).drop("_mode"))


def has_partner(df: DataFrame, col: str = "Marital_Status") -> DataFrame:
    """1 for Married / Together, else 0."""
    return df.withColumn("HasPartner", F.coalesce(F.col(col).isin(*PARTNER_STATUS), F.lit(False)).cast("int"))


def prepare_regression_frame(df: DataFrame, reference_year: int = FIXTURE_REFERENCE_YEAR,
                             min_age: int = 18, max_age: int = 100, max_income: float = 300000,
                             fill_status: str | None = None) -> DataFrame:
    """F3 + P6-P8 + P4: the recommender's preparation; ``fill_status`` is the fitted fill value of P7 when new rows are scored.

    The age bound is written on ``Year_Birth`` so it reaches the source scan.
    """
    require_columns(df, ["Year_Birth", "Income", "Education", "Marital_Status", "Kidhome", "Teenhome"])
    out = customer_age(df, reference_year)
    out = out.filter(F.col("Year_Birth").between(reference_year - max_age, reference_year - min_age))
    out = out.filter(F.col("Income").isNull() | (F.col("Income") <= max_income))
    out = group_rare_status(out)
    out = fill_mode_category(out, value=fill_status)
    out = has_partner(out)
    return total_children(out)


def feature_matrix(df: DataFrame, features: Sequence[str] = CLASSIFICATION_FEATURES,
                   label: str = "Response", key: str = "ID") -> DataFrame:
    """Key, the listed features that exist, integer label."""
    return df.select(key, *existing(df, features), F.col(label).cast("int").alias(label))


def stage_feature_columns(feature_sets: Mapping[str, Sequence[str]] = STAGE_FEATURE_SETS) -> list[str]:
    return sorted({c for cols in feature_sets.values() for c in cols})


def stage_feature_matrix(df: DataFrame, feature_sets: Mapping[str, Sequence[str]] = STAGE_FEATURE_SETS,
                         key: str = "ID") -> DataFrame:
    """P10: sorted union of all stage feature sets."""
    cols = stage_feature_columns(feature_sets)
    require_columns(df, cols)
    return df.select(key, *cols)


def spending_share_target(df: DataFrame, product_cols: Sequence[str] = PRODUCT_COLUMNS,
                          key: str = "ID", keep: Sequence[str] = ()) -> DataFrame:
    """Per-product share of spend, only rows with positive total spend."""
    require_columns(df, product_cols)
    total = row_sum_skip_nulls(product_cols)
    base = df.select(key, *keep, *product_cols, total.alias("_total")).filter(F.col("_total") > 0)
    return base.select(key, *keep, *[(F.col(c) / F.col("_total")).alias(c) for c in product_cols])


def drop_identifiers(df: DataFrame, keep_key: str | None = "ID") -> DataFrame:
    """Drop identifier and constant columns (the key stays as row identity)."""
    return df.drop(*[c for c in IDENTIFIER_COLUMNS if c != keep_key])
