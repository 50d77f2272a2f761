"""Data-quality and distribution summaries.

All of them are single-pass aggregates whose output size depends on the
number of columns / classes / bins, never on the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """S3: (column_name, missing) for columns with at least one NULL, one scan."""
    cols = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column_name", "missing")
    return long.filter(F.col("missing") > 0)


def target_distribution(df: DataFrame, label: str = "Response", digits: int = 4) -> DataFrame:
    """A5: count and share per class (share rounded half-even)."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    counts = df.groupBy(F.col(label).cast("int").alias(label)).agg(F.count(F.lit(1)).alias("count"))
    return (counts.crossJoin(F.broadcast(total))
            .select(label, "count", F.bround(F.col("count") / F.col("_n"), digits).alias("rate")))


def dataset_summary(raw: DataFrame, cleaned: DataFrame, features: Sequence[str], label: str = "Response",
                    cleaned_columns: int | None = None) -> DataFrame:
    """One-row summary of the classification input.

    Raw and cleaned counts come from two global aggregates; class counts and
    missing-value counts from one more aggregate over the cleaned rows.
    """
    raw_n = raw.agg(F.count(F.lit(1)).alias("raw_rows"))
    stats = cleaned.agg(
        F.count(F.lit(1)).alias("cleaned_rows"),
        F.count_if(F.col(label) == 0).alias("target_count_0"),
        F.count_if(F.col(label) == 1).alias("target_count_1"),
        *[F.count_if(F.col(c).isNull()).alias(f"_miss_{c}") for c in features],
    )
    n = F.col("cleaned_rows")
    missing = F.concat_ws(", ", *[F.when(F.col(f"_miss_{c}") > 0,
                                         F.concat(F.lit(f"{c}:"), F.col(f"_miss_{c}").cast("string")))
                                  for c in features])
    return raw_n.crossJoin(stats).select(
        "raw_rows",
        F.lit(len(raw.columns)).alias("raw_columns"),
        "cleaned_rows",
        F.lit(cleaned_columns if cleaned_columns is not None else len(cleaned.columns)).alias("cleaned_columns"),
        (F.col("raw_rows") - n).alias("removed_outlier_rows"),
        F.lit(len(features)).alias("feature_count"),
        "target_count_0", "target_count_1",
        F.bround(F.col("target_count_0") / n, 4).alias("target_rate_0"),
        F.bround(F.col("target_count_1") / n, 4).alias("target_rate_1"),
        missing.alias("missing_values_used_for_imputation"),
        F.lit(", ".join(features)).alias("features"),
    )


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """A10: equal-width histogram per column, min..max, last bin closed, all bins present.

    One aggregate finds the ranges, one grouped count fills the bins; the bin
    list (``bins`` rows per column) is generated, not collected.
    """
    parts = []
    for c in columns:
        rng = df.agg(F.min(c).cast("double").alias("_lo"), F.max(c).cast("double").alias("_hi"))
        width = (F.col("_hi") - F.col("_lo")) / bins
        x = df.select(F.col(c).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
        binned = (x.crossJoin(F.broadcast(rng))
                  .select(F.least(F.floor(F.coalesce(F.try_divide(F.col("_x") - F.col("_lo"), width), F.lit(0.0))),
                                  F.lit(bins - 1)).cast("int").alias("bin"))
                  .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
        grid = (df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
                .crossJoin(F.broadcast(rng)))
        parts.append(
            grid.join(binned, "bin", "left").select(
                F.lit(c).alias("feature"), "bin",
                (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
                (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
                F.coalesce(F.col("count"), F.lit(0).cast("bigint")).alias("count")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
