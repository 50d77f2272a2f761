"""Product-category ranking analytics.

A *score table* is keyed by ``ID`` and has one double column per product, in
the fixed product order.  Per-customer ranking is a sort of a six-element
array inside the row (no shuffle, no Python).  Priors, the baseline product
and the product list are one-row or six-row frames, so broadcasting them is
bounded by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.quantiles import exact_quantiles
from marketlens.functions.rowexpr import (banner_order, banner_scores, row_sum_skip_nulls, safe_ratio,
                                          top1_product)
from marketlens.schema import PRODUCT_COLUMNS

PRIOR_PREFIX = "prior_"


def normalize_shares(df: DataFrame, product_cols: Sequence[str] = PRODUCT_COLUMNS) -> DataFrame:
    """Clip at 0, divide by the row sum; a zero row stays all zeros."""
    clipped = [F.greatest(F.col(c), F.lit(0.0)).alias(c) for c in product_cols]
    others = [c for c in df.columns if c not in product_cols]
    d = df.select(*others, *clipped).withColumn("_rs", row_sum_skip_nulls(product_cols))
    return d.select(*others, *[safe_ratio(F.col(c), F.col("_rs")).alias(c) for c in product_cols])


def product_prior(shares: DataFrame, product_cols: Sequence[str] = PRODUCT_COLUMNS) -> DataFrame:
    """A2: one row of per-product mean share; a zero mean becomes NULL."""
    return shares.agg(*[F.nullif(F.avg(c), F.lit(0.0)).alias(PRIOR_PREFIX + c) for c in product_cols])


def fitted_prior(shares: DataFrame, product_cols: Sequence[str] = PRODUCT_COLUMNS) -> DataFrame:
    """A2 as a fitted constant: one local row that carries no lineage into what it scores."""
    prior = product_prior(shares, product_cols)
    return shares.sparkSession.createDataFrame(prior.collect(), prior.schema)


def relative_preference(shares: DataFrame, prior: DataFrame,
                        product_cols: Sequence[str] = PRODUCT_COLUMNS) -> DataFrame:
    """Share / prior per product; division by zero or NULL prior -> 0."""
    others = [c for c in shares.columns if c not in product_cols]
    j = shares.crossJoin(F.broadcast(prior))
    return j.select(*others, *[safe_ratio(F.col(c), F.col(PRIOR_PREFIX + c)).alias(c) for c in product_cols])


def with_top1(df: DataFrame, out: str, product_cols: Sequence[str] = PRODUCT_COLUMNS) -> DataFrame:
    """Name of the best product per row, first product on ties."""
    return df.withColumn(out, top1_product(product_cols, product_cols))


def baseline_product(train_top1: DataFrame, col: str = "Actual_Product") -> DataFrame:
    """A3: one row, the most frequent train top product (tie -> smallest name)."""
    return train_top1.agg(F.mode(col, True).alias("baseline_product"))


def match_rate(df: DataFrame, actual: str, predicted: str, group_by: Sequence[str] = ()) -> DataFrame:
    """A4: mean of (actual == predicted)."""
    rate = F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("match_rate")
    return df.groupBy(*group_by).agg(rate) if group_by else df.agg(rate)


def add_banner(df: DataFrame, product_cols: Sequence[str] = PRODUCT_COLUMNS,
               names: Sequence[str] | None = None) -> DataFrame:
    """W6 + W7: banner order and banner scores from score columns."""
    names = list(names or product_cols)
    return (df.withColumn("Banner_Ad_Order", banner_order(product_cols, names))
              .withColumn("Banner_Ad_Scores", banner_scores(product_cols, names)))


def prefix_columns(df: DataFrame, prefix: str, cols: Sequence[str], key: str = "ID") -> DataFrame:
    """``add_prefix`` on the listed columns."""
    return df.select(key, *[F.col(c).alias(prefix + c) for c in cols])


def prediction_frame(actual: DataFrame, predicted: DataFrame, prior: DataFrame,
                     product_cols: Sequence[str] = PRODUCT_COLUMNS, key: str = "ID") -> DataFrame:
    """4 x 6 score columns, top products, match flag, banner order and scores.

    ``actual`` holds true shares, ``predicted`` normalised predicted shares; both
    keyed by ``key``.  One join on the key; use ``scored_frame`` when one table already has both.
    """
    both = actual.select(key, *[F.col(c).alias("ActualRatio_" + c) for c in product_cols]).join(
        predicted.select(key, *[F.col(c).alias("PredictedRatio_" + c) for c in product_cols]), key)
    return scored_frame(both, prior, product_cols, key)


def scored_frame(both: DataFrame, prior: DataFrame, product_cols: Sequence[str] = PRODUCT_COLUMNS,
                 key: str = "ID") -> DataFrame:
    """E8 from a table with ``ActualRatio_`` and ``PredictedRatio_`` columns: projections and the one-row prior only."""
    ratio = lambda p, c: safe_ratio(F.col(p + c), F.col("prior_" + c))
    out = both.crossJoin(F.broadcast(prior)).select(
        key, *[F.col(p + c) for p in ("ActualRatio_", "PredictedRatio_") for c in product_cols],
        *[ratio("ActualRatio_", c).alias("ActualRelativeScore_" + c) for c in product_cols],
        *[ratio("PredictedRatio_", c).alias("RecommendationScore_" + c) for c in product_cols])
    a_cols = ["ActualRelativeScore_" + c for c in product_cols]
    r_cols = ["RecommendationScore_" + c for c in product_cols]
    out = (out.withColumn("Actual_Product", top1_product(a_cols, product_cols))
              .withColumn("Recommended_Product", top1_product(r_cols, product_cols)))
    out = out.withColumn("Recommendation_Match", F.col("Actual_Product") == F.col("Recommended_Product"))
    return (out.withColumn("Banner_Ad_Order", banner_order(r_cols, product_cols))
               .withColumn("Banner_Ad_Scores", banner_scores(r_cols, product_cols)))


def banner_output(frame: DataFrame, key: str = "ID") -> DataFrame:
    """The five recommendation columns."""
    return frame.select(key, "Actual_Product", "Recommended_Product", "Recommendation_Match",
                        "Banner_Ad_Order", "Banner_Ad_Scores")


def banner_positions(frame: DataFrame, key: str = "ID") -> DataFrame:
    """Banner order split into numbered positions (1-based)."""
    return frame.select(key, F.posexplode(F.split("Banner_Ad_Order", " > ")).alias("pos", "Product")) \
        .select(key, (F.col("pos") + 1).alias("position"), "Product")


def customer_score_table(frame: DataFrame, customer_id=None, key: str = "ID",
                         product_cols: Sequence[str] = PRODUCT_COLUMNS,
                         prefix: str = "RecommendationScore_") -> DataFrame:
    """One customer's scores, long, descending (default: smallest key).

    The result is always six rows; ``rank`` carries the descending order
    (ties by product order) so no global sort is needed.
    """
    if customer_id is None:
        first = frame.agg(F.min(key).alias("_pick"))
        one = frame.join(F.broadcast(first), F.col(key) == F.col("_pick")).drop("_pick")
    else:
        one = frame.filter(F.col(key) == F.lit(customer_id))
    long = one.select(key, F.inline(F.array(*[
        F.struct(F.lit(c).alias("Product"), F.lit(i).alias("_pos"), F.col(prefix + c).alias("RecommendationScore"))
        for i, c in enumerate(product_cols)])))
    w = Window.partitionBy(key).orderBy(F.col("RecommendationScore").desc(), "_pos")
    return long.withColumn("rank", F.row_number().over(w)).drop("_pos")


def product_confusion(frame: DataFrame, product_cols: Sequence[str] = PRODUCT_COLUMNS,
                      actual: str = "Actual_Product", predicted: str = "Recommended_Product") -> DataFrame:
    """Actual x recommended counts; all six rows and columns, zeros filled."""
    spark = frame.sparkSession
    products = spark.createDataFrame([(p,) for p in product_cols], ["Actual_Product"])
    counts = frame.groupBy(F.col(actual).alias("Actual_Product")).pivot(predicted, list(product_cols)) \
        .agg(F.count(F.lit(1)))
    out = products.join(counts, "Actual_Product", "left")
    return out.select("Actual_Product", *[F.coalesce(F.col(p), F.lit(0).cast("bigint")).alias(p)
                                          for p in product_cols])


def product_confusion_rate(confusion: DataFrame, product_cols: Sequence[str] = PRODUCT_COLUMNS) -> DataFrame:
    """Each row of A6 divided by its sum; an empty row stays zeros."""
    total = row_sum_skip_nulls(product_cols)
    return confusion.select("Actual_Product", *[safe_ratio(F.col(p).cast("double"), total).alias(p)
                                                for p in product_cols])


def product_distribution(frame: DataFrame, product_cols: Sequence[str] = PRODUCT_COLUMNS,
                         actual: str = "Actual_Product", predicted: str = "Recommended_Product") -> DataFrame:
    """Share of customers per product, actual vs recommended, zeros filled."""
    spark = frame.sparkSession
    long = frame.select(F.inline(F.array(F.struct(F.lit("Actual").alias("kind"), F.col(actual).alias("Product")),
                                         F.struct(F.lit("Recommended").alias("kind"),
                                                  F.col(predicted).alias("Product")))))
    n = frame.agg(F.count(F.lit(1)).alias("_n"))
    counts = long.groupBy("Product").pivot("kind", ["Actual", "Recommended"]).agg(F.count(F.lit(1)))
    products = spark.createDataFrame([(p,) for p in product_cols], ["Product"])
    return (products.join(counts, "Product", "left").crossJoin(F.broadcast(n))
            .select("Product", *[F.coalesce(F.col(k) / F.col("_n"), F.lit(0.0)).alias(k)
                                 for k in ("Actual", "Recommended")]))


def error_sums(product_cols: Sequence[str] = PRODUCT_COLUMNS, a: str = "a_", p: str = "p_") -> list:
    """Aggregates behind R2, MAE and RMSE: errors, and the spread of the actual values around their mean (stable, one pass)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in product_cols:
        e = F.col(p + c) - F.col(a + c)
        aggs += [F.sum(e * e).alias("sse_" + c), F.sum(F.abs(e)).alias("sae_" + c), F.var_pop(a + c).alias("var_" + c)]
    return aggs


def metrics_by(pred: DataFrame, group: Sequence[str] = (), product_cols: Sequence[str] = PRODUCT_COLUMNS,
               a: str = "a_", p: str = "p_") -> DataFrame:
    """R2 averaged uniformly over outputs, MAE over all cells and RMSE = sqrt(mean MSE) of each group, in one aggregate."""
    s = pred.groupBy(*group).agg(*error_sums(product_cols, a, p))
    k, total = len(product_cols), lambda cols: sum(cols[1:], cols[0])
    sst = {c: F.col("var_" + c) * F.col("n") for c in product_cols}
    r2 = [F.when(sst[c] == 0, F.when(F.col("sse_" + c) == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(1 - F.col("sse_" + c) / sst[c]) for c in product_cols]
    return s.select(*group, (total(r2) / k).alias("r2"),
                    (total([F.col("sae_" + c) for c in product_cols]) / (F.col("n") * k)).alias("mae"),
                    F.sqrt(total([F.col("sse_" + c) for c in product_cols]) / (F.col("n") * k)).alias("rmse"))


def regression_metrics(actual: DataFrame, predicted: DataFrame, product_cols: Sequence[str] = PRODUCT_COLUMNS,
                       key: str = "ID") -> DataFrame:
    """E5: metrics of two frames, by one join on the key and one aggregate."""
    a = actual.select(key, *[F.col(c).alias("a_" + c) for c in product_cols])
    p = predicted.select(key, *[F.col(c).alias("p_" + c) for c in product_cols])
    return metrics_by(a.join(p, key), (), product_cols)


def mean_std(metrics: DataFrame, group: Sequence[str], value: str = "r2") -> DataFrame:
    """V6: mean and population deviation of a metric over the folds of each group."""
    return metrics.groupBy(*group).agg(F.avg(value).alias(f"{value}_mean"), F.stddev_pop(value).alias(f"{value}_std"))


def product_diagnostics(frame: DataFrame, product_cols: Sequence[str] = PRODUCT_COLUMNS, actual: str = "Actual_Product",
                        predicted: str = "Recommended_Product") -> DataFrame:
    """Confusion counts, their row rates and the distribution of both, stacked as (table, row, products, Actual, Recommended)."""
    conf = product_confusion(frame, product_cols, actual, predicted)
    none = F.lit(None).cast("double")
    parts = [conf.select(F.lit("count").alias("table"), F.col("Actual_Product").alias("row"), *[F.col(c).cast("double").alias(c) for c in product_cols],
                         none.alias("Actual"), none.alias("Recommended")),
             product_confusion_rate(conf, product_cols).select(F.lit("rate").alias("table"), F.col("Actual_Product").alias("row"), *product_cols,
                                                               none.alias("Actual"), none.alias("Recommended")),
             product_distribution(frame, product_cols, actual, predicted).select(
                 F.lit("distribution").alias("table"), F.col("Product").alias("row"), *[none.alias(c) for c in product_cols], "Actual", "Recommended")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def best_per_group(summary: DataFrame, group: str, order: Sequence) -> DataFrame:
    """Top row per group by the given ordering (row_number = 1)."""
    w = Window.partitionBy(group).orderBy(*order)
    return summary.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def melt_metrics(summary: DataFrame, ids: Sequence[str], values: Sequence[str],
                 var_name: str = "Metric", value_name: str = "R2") -> DataFrame:
    """Wide metric columns to long (Metric, value)."""
    return summary.unpivot(list(ids), list(values), var_name, value_name)


def income_band(df: DataFrame, col: str = "Income") -> DataFrame:
    """Quartile band of ``col`` (exact linear-interpolated quartiles)."""
    q = exact_quantiles(df, [col], (0.25, 0.5, 0.75))[col]
    x = F.col(col)
    if q[0] is None:
        return df.withColumn("IncomeGroup", F.lit("Unknown"))
    return df.withColumn("IncomeGroup", F.when(x.isNull(), F.lit("Unknown")).when(x <= q[0], F.lit("Q1"))
                         .when(x <= q[1], F.lit("Q2")).when(x <= q[2], F.lit("Q3")).otherwise(F.lit("Q4")))


def rec_by_income_band(frame_with_income: DataFrame, product: str = "Recommended_Product") -> DataFrame:
    """Recommendation counts and within-band shares per income quartile."""
    b = income_band(frame_with_income)
    counts = b.groupBy("IncomeGroup", F.col(product).alias("Product")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("IncomeGroup")
    return counts.withColumn("share", F.col("count") / F.sum("count").over(w))


def rec_by_family_segment(frame_with_family: DataFrame, product: str = "Recommended_Product") -> DataFrame:
    """Recommendation counts and shares per HasPartner x has-children segment."""
    d = frame_with_family.withColumn("HasChildren", (F.col("TotalChildren") > 0).cast("int"))
    counts = d.groupBy("HasPartner", "HasChildren", F.col(product).alias("Product")) \
        .agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("HasPartner", "HasChildren")
    return counts.withColumn("share", F.col("count") / F.sum("count").over(w))
