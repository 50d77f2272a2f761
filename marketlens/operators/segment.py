"""Customer segmentation: K-Means, k selection, silhouette, inertia, profiles, personas, PCA.

Scale notes
-----------
* Cluster statistics (k rows: size, vector sum, sum of squared norms) are the
  only thing broadcast; k is a parameter, never the data size.
* Silhouette uses the *squared* Euclidean distance, for which the mean distance
  from a point to a whole cluster has the closed form
  ``|x|^2 - 2 x.S_C / n_C + Q_C / n_C``: exact, one pass, no pairs.  The plain
  Euclidean silhouette of the published workflow has no such form and needs
  every pair of points, which this library does not materialise (see README).
* Persona rules run on the k-row profile only.
* K-Means advances all starts of all k in the same passes (``operators.kmeans``); the lowest cost is kept, and all silhouettes of
  the k selection come from one more pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.rowexpr import avg_tie_pct_rank
from marketlens.operators import kmeans
from marketlens.schema import (PERSONA_HIGH_VALUE, PERSONA_LOW, PERSONA_MIDDLE, PERSONA_RESPONSIVE,
                               PROFILE_BASE_COLUMNS)
from marketlens.session import materialize

PROFILE_MEAN_COLUMNS = [f"{c}_mean" for c in PROFILE_BASE_COLUMNS]
HEATMAP_COLUMNS = PROFILE_MEAN_COLUMNS + ["Response_Rate"]


# ---------------------------------------------------------------------------
# ordering helper: exact ntile without a single-partition window
# ---------------------------------------------------------------------------
def global_row_number(df: DataFrame, order_cols: Sequence[str], n_parts: int | None = None,
                      out: str = "_row") -> DataFrame:
    """1-based row number in ``order_cols`` order (must be a total order).

    Range partitioning on the full sort key spreads even a hot leading value
    over many tasks; each task numbers its sorted rows locally and a
    per-partition count (one row per partition, broadcast) gives the offsets.
    """
    spark = df.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written once: the counts and the rows must see the same partitions, also after an executor is lost
    s = materialize(df.repartitionByRange(n_parts, *order_cols).sortWithinPartitions(*order_cols)
                    .withColumn("_pid", F.spark_partition_id())
                    .withColumn("_idx", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), 33)))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_idx") + 1).drop("_pid", "_idx", "_off"))


def ntile_labels(df: DataFrame, n: int = 4, order_cols: Sequence[str] = ("TotalSpending", "ID"),
                 out: str = "Cluster") -> DataFrame:
    """``ntile(n) - 1`` over ``order_cols`` (SQL semantics: larger tiles first)."""
    ranked = global_row_number(df, order_cols)
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    r = F.col("_row") - 1
    q, rem = F.floor(F.col("_n") / n), F.col("_n") % n
    # the first `rem` tiles have q+1 rows
    big = rem * (q + 1)
    tile = F.when(r < big, F.floor(r / (q + 1))).otherwise(rem + F.floor((r - big) / q))
    return (ranked.crossJoin(F.broadcast(total)).withColumn(out, tile.cast("int")).drop("_row", "_n"))


# ---------------------------------------------------------------------------
# A1 / A11 / A9 and personas
# ---------------------------------------------------------------------------
def cluster_profile(clustered: DataFrame, label: str = "Cluster") -> DataFrame:
    """A1: per cluster means (2 dp, half-even), size, response rate (3 dp)."""
    return clustered.groupBy(F.col(label).cast("int").alias("Cluster")).agg(
        F.count(F.lit(1)).alias("CustomerCount"),
        *[F.bround(F.avg(c), 2).alias(f"{c}_mean") for c in PROFILE_BASE_COLUMNS],
        F.bround(F.avg("Response"), 3).alias("Response_Rate"))


def response_rate_by_segment(clustered: DataFrame, label: str = "Cluster") -> DataFrame:
    """Response rate per cluster (bar-chart series)."""
    return clustered.groupBy(F.col(label).cast("int").alias("Cluster")).agg(
        F.bround(F.avg("Response"), 3).alias("Response_Rate"))


def profile_zscores(profile: DataFrame, cols: Sequence[str] = HEATMAP_COLUMNS) -> DataFrame:
    """Each profile column standardised over clusters (ddof 0); inf / NaN -> 0."""
    stats = profile.agg(*[F.avg(c).alias(f"_mu_{c}") for c in cols],
                        *[F.stddev_pop(c).alias(f"_sd_{c}") for c in cols])
    j = profile.crossJoin(F.broadcast(stats))
    return j.select("Cluster", *[F.coalesce(F.try_divide(F.col(c) - F.col(f"_mu_{c}"),
                                                         F.nullif(F.col(f"_sd_{c}"), F.lit(0.0))),
                                            F.lit(0.0)).alias(c) for c in cols])


def value_score(profile: DataFrame) -> DataFrame:
    """Sum of average-tie percentile ranks of income, spend and purchases."""
    return profile.withColumn("value_score",
                              avg_tie_pct_rank("Income_mean") + avg_tie_pct_rank("TotalSpending_mean")
                              + avg_tie_pct_rank("TotalPurchases_mean"))


def persona_labels(profile: DataFrame) -> DataFrame:
    """W2 (k = 4) / W3 (other k): ``Cluster -> Persona_Label`` on the k-row profile.

    k = 4: lowest value score -> low persona; of the rest the highest response
    rate -> responsive; of the rest the highest value score -> high value;
    the last -> middle.  Ties go to the smaller cluster id.  Other k: each of
    income, spend and response compared with its median over clusters.
    """
    k = profile.count()  # k rows
    if k != 4:
        med = profile.agg(*[F.median(c).alias(f"_md_{c}") for c in
                            ("Income_mean", "TotalSpending_mean", "Response_Rate")])
        j = profile.crossJoin(F.broadcast(med))
        text = F.concat_ws(", ",
                           F.when(F.col("Income_mean") >= F.col("_md_Income_mean"), "High-income")
                           .otherwise("Low-income"),
                           F.when(F.col("TotalSpending_mean") >= F.col("_md_TotalSpending_mean"), "High-spending")
                           .otherwise("Low-spending"),
                           F.concat(F.when(F.col("Response_Rate") >= F.col("_md_Response_Rate"), "Responsive")
                                    .otherwise("Less-responsive"), F.lit(" customers")))
        return j.select("Cluster", text.alias("Persona_Label"))
    v = value_score(profile)
    low = F.row_number().over(Window.orderBy(F.col("value_score").asc(), "Cluster"))
    v = v.withColumn("_low", low == 1)
    resp = F.row_number().over(Window.partitionBy("_low").orderBy(F.col("Response_Rate").desc(), "Cluster"))
    v = v.withColumn("_resp", (~F.col("_low")) & (resp == 1))
    hv = F.row_number().over(Window.partitionBy(F.col("_low") | F.col("_resp"))
                             .orderBy(F.col("value_score").desc(), "Cluster"))
    v = v.withColumn("_hv", (~F.col("_low")) & (~F.col("_resp")) & (hv == 1))
    label = (F.when(F.col("_low"), PERSONA_LOW).when(F.col("_resp"), PERSONA_RESPONSIVE)
             .when(F.col("_hv"), PERSONA_HIGH_VALUE).otherwise(PERSONA_MIDDLE))
    return v.select("Cluster", label.alias("Persona_Label"))


def profile_with_personas(clustered: DataFrame, label: str = "Cluster") -> DataFrame:
    """A1 + J5: the profile table with its persona column (k rows)."""
    prof = cluster_profile(clustered, label)
    return prof.join(F.broadcast(persona_labels(prof)), "Cluster", "left")


# ---------------------------------------------------------------------------
# M9 / M10 on any labelled vectors (array<double> or vector column)
# ---------------------------------------------------------------------------
def _as_array(df: DataFrame, features: str) -> DataFrame:
    dt = df.schema[features].dataType.typeName()
    return df if dt == "array" else df.withColumn(features, vector_to_array(features))


def cluster_stats(df: DataFrame, features: str = "features", label: str = "Cluster") -> DataFrame:
    """Per cluster: size, vector sum, sum of squared norms (k rows)."""
    d = _as_array(df, features)
    dim = len(d.select(features).first()[0])
    return d.groupBy(F.col(label).alias("_c")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.array(*[F.sum(F.col(features)[i]) for i in range(dim)]).alias("_s"),
        F.sum(F.aggregate(F.col(features), F.lit(0.0), lambda acc, x: acc + x * x)).alias("_q"))


def inertia(df: DataFrame, features: str = "features", label: str = "Cluster") -> DataFrame:
    """Sum of squared distances to the own cluster mean (one row), from the spread around it (no cancellation)."""
    d = _as_array(df, features)
    dim = len(d.select(features).first()[0])
    spread = sum([F.var_pop(F.col(features)[i]) for i in range(1, dim)], F.var_pop(F.col(features)[0]))
    per = d.groupBy(F.col(label).alias("_c")).agg((F.count(F.lit(1)) * spread).alias("_w"))
    return per.agg(F.sum("_w").alias("inertia"))


def silhouette_sq(df: DataFrame, features: str = "features", label: str = "Cluster",
                  key: str = "ID", per_point: bool = False) -> DataFrame:
    """M9 with squared Euclidean distance, exact, no pairs.

    a = own-cluster mean distance over the other members (n_C - 1),
    b = smallest mean distance to another cluster; s = (b - a) / max(a, b);
    a point alone in its cluster scores 0.
    """
    d = _as_array(df, features)
    st = cluster_stats(d, features, label)
    packed = st.agg(F.collect_list(F.struct("_c", "_n", "_s", "_q")).alias("_cl"))  # k elements
    j = d.select(key, F.col(label).alias("_own"), features).crossJoin(F.broadcast(packed))
    x = F.col(features)
    xx = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)

    def total_sq(c):  # sum over members y of |x - y|^2
        dot = F.aggregate(F.arrays_zip(x.alias("x"), c["_s"].alias("s")), F.lit(0.0),
                          lambda a, z: a + z["x"] * z["s"])
        return c["_n"] * xx - 2 * dot + c["_q"]

    dists = F.transform(F.col("_cl"), lambda c: F.struct(c["_c"].alias("c"), c["_n"].alias("n"),
                                                         total_sq(c).alias("t")))
    j = j.withColumn("_d", dists)
    own = F.filter(F.col("_d"), lambda z: z["c"] == F.col("_own"))[0]
    others = F.filter(F.col("_d"), lambda z: z["c"] != F.col("_own"))
    a = F.when(own["n"] > 1, own["t"] / (own["n"] - 1))
    b = F.array_min(F.transform(others, lambda z: z["t"] / z["n"]))
    s = F.when(own["n"] <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    pts = j.select(key, F.col("_own").alias(label), s.alias("silhouette"))
    if per_point:
        return pts
    return pts.agg(F.avg("silhouette").alias("silhouette_score"))


# ---------------------------------------------------------------------------
# K-Means, k selection, PCA
# ---------------------------------------------------------------------------
def fit_kmeans(vectors: DataFrame, k: int, seed: int = 42, n_init: int = 10, max_iter: int = 300,
               features: str = "features", key: str = "ID") -> kmeans.CentroidModel:
    """Best of ``n_init`` starts (seeds seed..seed+n_init-1) by cost."""
    return kmeans.fit_many(vectors, [k], seed, n_init, max_iter, features, key).models[k]


def relabel_by(clustered: DataFrame, order_col: str = "TotalSpending", label: str = "Cluster") -> DataFrame:
    """Renumber arbitrary cluster ids 0..k-1 by ascending mean of ``order_col``."""
    means = clustered.groupBy(label).agg(F.avg(order_col).alias("_m"))
    ranked = means.select(label, (F.row_number().over(Window.orderBy("_m", label)) - 1).alias("_new"))
    return (clustered.join(F.broadcast(ranked), label)
            .withColumn(label, F.col("_new").cast("int")).drop("_new"))


def k_selection(vectors: DataFrame, k_values: Sequence[int] = range(2, 9), seed: int = 42, n_init: int = 10,
                features: str = "features", key: str = "ID"):
    """M8: (k, silhouette_score, inertia) per candidate k.

    Returns the score table and the fitted models by k (the caller reuses the
    final-k model instead of fitting it again).
    """
    many = kmeans.fit_many(vectors, list(k_values), seed, n_init, features=features, key=key)
    scores = many.silhouettes()
    rows = [(int(k), scores[k], float(many.models[k].cost)) for k in k_values]
    return vectors.sparkSession.createDataFrame(rows, "k int, silhouette_score double, inertia double"), many.models


def pca_2d(vectors: DataFrame, features: str = "features", keep: Sequence[str] = ("ID",)):
    """First two principal components; sign fixed so the largest loading is positive.

    Returns (projected rows, explained variance ratios).  The input is
    standardised, so MLlib's uncentred projection equals the centred one.
    """
    model = PCA(k=2, inputCol=features, outputCol="_pc").fit(vectors)
    loadings = model.pc.toArray()  # dim x 2, small
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    out = model.transform(vectors).withColumn("_pc", vector_to_array("_pc"))
    out = out.select(*keep, (F.col("_pc")[0] * signs[0]).alias("PC1"), (F.col("_pc")[1] * signs[1]).alias("PC2"))
    return out, [float(v) for v in model.explainedVariance.toArray()]
