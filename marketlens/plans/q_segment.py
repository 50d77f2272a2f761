"""Segmentation queries.

SQL-checked ones use fixed labels, ``Cluster = ntile(4) over (TotalSpending, ID) - 1``
on the clustering rows (FIXTURES.md), so profile, persona, silhouette and
inertia logic is verified independently of K-Means.  The K-Means driven
queries (M7, M8, T9 and the final profile) are rows-only checks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from marketlens.operators import kmeans, prep, segment as G
from marketlens.plans.oracle import fragment, sql_str, sql_with
from marketlens.plans.q_prepare import clu_clean
from marketlens.plans.registry import register, kept_result
from marketlens.schema import (CLUSTER_FEATURES, PERSONA_HIGH_VALUE, PERSONA_LOW, PERSONA_MIDDLE,
                               PERSONA_RESPONSIVE, PROFILE_BASE_COLUMNS)
from marketlens.session import materialize
from marketlens.sources.tables import read_table


# --- Spark pipelines -------------------------------------------------------------------
def clu_vectors(spark, sf, with_rows: bool = False):
    """T8 scaled 13-feature vectors of the clustering rows (fit on all of them)."""
    d = clu_clean(spark, sf)
    fitted = prep.fit_preprocessor(d, numeric=CLUSTER_FEATURES)
    keep = ["ID", *PROFILE_BASE_COLUMNS, "Response"] if with_rows else ["ID"]
    return fitted.transform(d, keep=keep)


def fixed_labelled(spark, sf, n: int = 4):
    return G.ntile_labels(clu_vectors(spark, sf, with_rows=True), n)


@kept_result("kmeans_k4")
def kmeans_labelled(spark, sf):
    """Best of 10 starts with k = 4, ids renumbered by mean spend."""
    vec = materialize(clu_vectors(spark, sf, with_rows=True))
    model = G.fit_kmeans(vec, 4, n_init=10)
    return materialize(G.relabel_by(model.transform(vec), "TotalSpending"))


# --- SQL fragments -------------------------------------------------------------------
fragment("clu_fixed", "SELECT c.*, CAST(ntile(4) OVER (ORDER BY c.TotalSpending, c.ID) - 1 AS INTEGER) AS Cluster "
         "FROM clu_clean c", ("clu_clean",))
fragment("clu_fixed3", "SELECT c.*, CAST(ntile(3) OVER (ORDER BY c.TotalSpending, c.ID) - 1 AS INTEGER) AS Cluster "
         "FROM clu_clean c", ("clu_clean",))
_PROF = ("SELECT Cluster, CAST(count(*) AS BIGINT) AS CustomerCount, "
         + ", ".join(f"round_even(avg({c}), 2) AS {c}_mean" for c in PROFILE_BASE_COLUMNS)
         + ", round_even(avg(Response), 3) AS Response_Rate FROM {src} GROUP BY Cluster")
fragment("fixed_profile", _PROF.format(src="clu_fixed"), ("clu_fixed",))
fragment("fixed_profile3", _PROF.format(src="clu_fixed3"), ("clu_fixed3",))


def _pr(c: str) -> str:
    return (f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()")


fragment("fixed_value", f"SELECT *, {_pr('Income_mean')} + {_pr('TotalSpending_mean')} + "
         f"{_pr('TotalPurchases_mean')} AS value_score FROM fixed_profile", ("fixed_profile",))
fragment("fixed_persona",
         "SELECT v.Cluster, CASE WHEN v.Cluster = lo.c THEN " + sql_str(PERSONA_LOW)
         + " WHEN v.Cluster = rs.c THEN " + sql_str(PERSONA_RESPONSIVE)
         + " WHEN v.Cluster = hv.c THEN " + sql_str(PERSONA_HIGH_VALUE)
         + " ELSE " + sql_str(PERSONA_MIDDLE) + " END AS Persona_Label FROM fixed_value v, "
         "(SELECT Cluster AS c FROM fixed_value ORDER BY value_score, Cluster LIMIT 1) lo, "
         "(SELECT Cluster AS c FROM fixed_value WHERE Cluster <> (SELECT Cluster FROM fixed_value ORDER BY value_score, Cluster LIMIT 1) "
         "ORDER BY Response_Rate DESC, Cluster LIMIT 1) rs, "
         "(SELECT Cluster AS c FROM fixed_value WHERE Cluster <> (SELECT Cluster FROM fixed_value ORDER BY value_score, Cluster LIMIT 1) "
         "AND Cluster <> (SELECT Cluster FROM fixed_value WHERE Cluster <> (SELECT Cluster FROM fixed_value ORDER BY value_score, Cluster LIMIT 1) "
         "ORDER BY Response_Rate DESC, Cluster LIMIT 1) ORDER BY value_score DESC, Cluster LIMIT 1) hv",
         ("fixed_value",))

# --- A1, W1, W2, W3, A9, A11, J5 -------------------------------------------------------------
register("cluster_profile", sql_with("SELECT * FROM fixed_profile", "fixed_profile"))(
    lambda spark, sf: G.cluster_profile(fixed_labelled(spark, sf)))
register("value_score", sql_with("SELECT Cluster, value_score FROM fixed_value", "fixed_value"))(
    lambda spark, sf: G.value_score(G.cluster_profile(fixed_labelled(spark, sf))).select("Cluster", "value_score"))
register("persona_labels_k4", sql_with("SELECT * FROM fixed_persona", "fixed_persona"))(
    lambda spark, sf: G.persona_labels(G.cluster_profile(fixed_labelled(spark, sf))))
register("persona_labels_any_k", sql_with(
    "SELECT Cluster, concat_ws(', ', CASE WHEN Income_mean >= m.mi THEN 'High-income' ELSE 'Low-income' END, "
    "CASE WHEN TotalSpending_mean >= m.ms THEN 'High-spending' ELSE 'Low-spending' END, "
    "CASE WHEN Response_Rate >= m.mr THEN 'Responsive' ELSE 'Less-responsive' END || ' customers') AS Persona_Label "
    "FROM fixed_profile3 CROSS JOIN (SELECT median(Income_mean) AS mi, median(TotalSpending_mean) AS ms, "
    "median(Response_Rate) AS mr FROM fixed_profile3) m", "fixed_profile3"))(
    lambda spark, sf: G.persona_labels(G.cluster_profile(fixed_labelled(spark, sf, 3))))
register("persona_lookup", sql_with(
    "SELECT p.*, f.Persona_Label FROM fixed_profile p LEFT JOIN fixed_persona f ON p.Cluster = f.Cluster",
    "fixed_profile", "fixed_persona"))(
    lambda spark, sf: G.profile_with_personas(fixed_labelled(spark, sf)))
register("response_rate_by_segment", sql_with(
    "SELECT Cluster, round_even(avg(Response), 3) AS Response_Rate FROM clu_fixed GROUP BY Cluster", "clu_fixed"))(
    lambda spark, sf: G.response_rate_by_segment(fixed_labelled(spark, sf)))
register("profile_zscores", sql_with(
    "SELECT Cluster, " + ", ".join(
        f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) AS {c}" for c in G.HEATMAP_COLUMNS)
    + " FROM fixed_profile", "fixed_profile"))(
    lambda spark, sf: G.profile_zscores(G.cluster_profile(fixed_labelled(spark, sf))))

# --- M9 / M10 with fixed labels on the T8 vectors --------------------------------------------------
fragment("clu_fixed_scaled", "SELECT s.*, f.Cluster FROM clu_scaled s JOIN clu_fixed f ON s.ID = f.ID",
         ("clu_scaled", "clu_fixed"))
_SQ = " + ".join(f"power(p.{c} - q.{c}, 2)" for c in CLUSTER_FEATURES)
register("inertia", sql_with(
    "SELECT sum(" + " + ".join(f"power(p.{c} - m.{c}, 2)" for c in CLUSTER_FEATURES) + ") AS inertia "
    "FROM clu_fixed_scaled p JOIN (SELECT Cluster, " + ", ".join(f"avg({c}) AS {c}" for c in CLUSTER_FEATURES)
    + " FROM clu_fixed_scaled GROUP BY Cluster) m ON p.Cluster = m.Cluster", "clu_fixed_scaled"))(
    lambda spark, sf: G.inertia(fixed_labelled(spark, sf)))

# Oracle silhouette: brute force over all pairs in DuckDB (fine at the check scale);
# Spark uses the exact closed form without pairs.
register("silhouette", sql_with(
    "SELECT avg(s) AS silhouette_score FROM (SELECT id, CASE WHEN max(own_n) <= 1 THEN 0 ELSE "
    "coalesce((min(CASE WHEN NOT own THEN md END) - max(CASE WHEN own THEN md END)) / "
    "nullif(greatest(min(CASE WHEN NOT own THEN md END), max(CASE WHEN own THEN md END)), 0), 0) END AS s FROM ("
    "SELECT p.ID AS id, q.Cluster = p.Cluster AS own, q.Cluster, max(n.n) AS own_n, "
    f"CASE WHEN q.Cluster = p.Cluster THEN sum({_SQ}) / nullif(count(*) - 1, 0) ELSE avg({_SQ}) END AS md "
    "FROM clu_fixed_scaled p JOIN clu_fixed_scaled q ON true "
    "JOIN (SELECT Cluster, count(*) AS n FROM clu_fixed_scaled GROUP BY Cluster) n ON n.Cluster = p.Cluster "
    "GROUP BY p.ID, p.Cluster, q.Cluster) GROUP BY id)", "clu_fixed_scaled"))(
    lambda spark, sf: G.silhouette_sq(fixed_labelled(spark, sf)))


# --- K-Means driven (rows-only) ----------------------------------------------------------------------
register("kmeans_segments", note="M7: best of 10 starts, ids renumbered by mean spend")(
    lambda spark, sf: kmeans_labelled(spark, sf).select("ID", "Cluster"))
register("segment_profile", note="A1 + W2 + J5 on K-Means labels (clustering_profile)")(
    lambda spark, sf: G.profile_with_personas(kmeans_labelled(spark, sf)))


@register("k_selection", note="M8: k = 2..8, squared-Euclidean silhouette and inertia")
def q_k_selection(spark, sf):
    table, _ = G.k_selection(clu_vectors(spark, sf))
    return table


def _fixed_start_sql(k: int = 4, rounds: int = 3) -> str:
    """Rounds of the algorithm from the rows with the ``k`` smallest ids, as table expressions over long points."""
    cells = " UNION ALL ".join(f"SELECT ID, '{c}' AS f, {c} AS x FROM clu_scaled" for c in CLUSTER_FEATURES)
    steps = [f"pts AS MATERIALIZED ({cells})",
             f"c0 AS (SELECT r - 1 AS c, f, x FROM pts JOIN (SELECT ID, row_number() OVER (ORDER BY ID) AS r FROM clu_scaled) USING (ID) WHERE r <= {k})"]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT ID, c, d FROM (SELECT p.ID, m.c, sum((p.x - m.x) * (p.x - m.x)) AS d, row_number() OVER ("
                     f"PARTITION BY p.ID ORDER BY sum((p.x - m.x) * (p.x - m.x)), m.c) AS place FROM pts p JOIN c{i} m USING (f) GROUP BY p.ID, m.c) WHERE place = 1)")
        if i < rounds:
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT m.c, m.f, coalesce(n.x, m.x) AS x FROM c{i} m LEFT JOIN (SELECT c, f, avg(x) AS x FROM pts "
                         f"JOIN a{i} USING (ID) GROUP BY c, f) n USING (c, f))")
    centres = ", ".join(f"max(CASE WHEN f = '{c}' THEN x END) AS {c}" for c in CLUSTER_FEATURES)
    return ("SELECT * FROM (WITH " + ", ".join(steps) + f" SELECT CAST(m.c AS INTEGER) AS Cluster, CAST(coalesce(s.n, 0) AS BIGINT) AS CustomerCount, t.cost, m.* EXCLUDE (c) FROM ("
            f"SELECT c, {centres} FROM c{rounds} GROUP BY c) m LEFT JOIN (SELECT c, count(*) AS n FROM a{rounds} GROUP BY c) s USING (c), "
            f"(SELECT sum(d) AS cost FROM a{rounds}) t)")


@register("kmeans_fixed_start", sql_with(_fixed_start_sql(), "clu_scaled"), note="M7 from given first centres, three rounds: centres, sizes and cost")
def q_kmeans_fixed_start(spark, sf, k: int = 4, rounds: int = 3):
    vec = clu_vectors(spark, sf)
    first = np.array([r["features"].toArray() for r in vec.orderBy("ID").limit(k).collect()])
    rows, shift = kmeans.stored_vectors(vec), np.zeros(first.shape[1])
    centres, _ = kmeans.lloyd(rows, {(k, 0): first}, shift, rounds, tolerance=-1.0)[k, 0]
    sums = kmeans._advance(rows, {(k, 0): centres}, shift)[k, 0]
    table = [(c, int(sums[1][c]), sums[2], *map(float, centres[c])) for c in range(k)]
    return spark.createDataFrame(table, "Cluster int, CustomerCount long, cost double, " + ", ".join(f"{c} double" for c in CLUSTER_FEATURES))


@register("pca_2d", note="T9: PC1, PC2 of the scaled clustering features with K-Means labels")
def q_pca_2d(spark, sf):
    labelled = kmeans_labelled(spark, sf)
    proj, ratios = G.pca_2d(labelled, keep=["ID", "Cluster"])
    return proj.withColumn("explained_variance_ratio", F.lit(sum(ratios)))


# --- named joins of section 2 inside the persona chain -----------------------------------------------
register("profile_join", sql_with("SELECT * FROM fixed_profile", "fixed_profile"),
         note="J1: means, counts and response rate per cluster fused in one aggregate")(
    lambda spark, sf: G.cluster_profile(fixed_labelled(spark, sf)))


@register("exclude_labelled", sql_with(
    "SELECT Cluster, value_score, Response_Rate FROM fixed_value WHERE Cluster NOT IN "
    "(SELECT Cluster FROM fixed_value ORDER BY value_score, Cluster LIMIT 1)", "fixed_value"),
    note="J4: clusters left after the low-value persona is assigned (left anti join)")
def q_exclude_labelled(spark, sf):
    from pyspark.sql import Window
    v = G.value_score(G.cluster_profile(fixed_labelled(spark, sf)))
    low = v.withColumn("_r", F.row_number().over(Window.orderBy("value_score", "Cluster"))) \
        .filter("_r = 1").select("Cluster")
    return v.join(F.broadcast(low), "Cluster", "left_anti").select("Cluster", "value_score", "Response_Rate")


# --- the same operators on the second input: the embeddings table --------------------------------------
def embedding_vectors(spark, sf):
    """ID, 64-d vector as array<double>, the given label as cluster id."""
    e = read_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("ID"), F.transform("embedding", lambda x: x.cast("double")).alias("features"),
                    F.col("label").cast("int").alias("Cluster"))


fragment("emb_long", "SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, "
         "generate_subscripts(embedding, 1) AS i FROM embeddings")
register("embedding_inertia", sql_with(
    "SELECT sum((e.x - m.mx) * (e.x - m.mx)) AS inertia FROM emb_long e JOIN "
    "(SELECT label, i, avg(x) AS mx FROM emb_long GROUP BY label, i) m USING (label, i)", "emb_long"),
    note="M10 on the embeddings table, label as cluster")(
    lambda spark, sf: G.inertia(embedding_vectors(spark, sf), "features", "Cluster"))
register("embedding_silhouette", sql_with(
    "SELECT avg(s) AS silhouette_score FROM (SELECT p, CASE WHEN max(own_n) <= 1 THEN 0 ELSE "
    "coalesce((min(CASE WHEN NOT own THEN md END) - max(CASE WHEN own THEN md END)) / "
    "nullif(greatest(min(CASE WHEN NOT own THEN md END), max(CASE WHEN own THEN md END)), 0), 0) END AS s FROM ("
    "SELECT d.p, lq.label = lp.label AS own, lq.label, max(n.n) AS own_n, "
    "CASE WHEN lq.label = lp.label THEN sum(d.d2) / nullif(count(*) - 1, 0) ELSE avg(d.d2) END AS md "
    "FROM (SELECT a.vec_id AS p, b.vec_id AS q, sum((a.x - b.x) * (a.x - b.x)) AS d2 FROM emb_long a "
    "JOIN emb_long b ON a.i = b.i GROUP BY 1, 2) d JOIN embeddings lp ON lp.vec_id = d.p "
    "JOIN embeddings lq ON lq.vec_id = d.q JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) n "
    "ON n.label = lp.label GROUP BY d.p, lp.label, lq.label) GROUP BY p)", "emb_long"),
    note="M9 (squared Euclidean) on the embeddings table, label as cluster")(
    lambda spark, sf: G.silhouette_sq(embedding_vectors(spark, sf), "features", "Cluster"))


@register("embedding_kmeans", note="M7 on the embeddings table: assignments for k = number of labels")
def q_embedding_kmeans(spark, sf):
    vec = embedding_vectors(spark, sf).select("ID", "features")
    k = read_table(spark, sf, "embeddings").select("label").distinct().count()
    return G.fit_kmeans(vec, max(k, 2), n_init=10).transform(vec).select("ID", "Cluster")


@register("embedding_pca", note="T9 on the embeddings table (2 components, sign-fixed)")
def q_embedding_pca(spark, sf):
    from pyspark.ml.functions import array_to_vector
    vec = embedding_vectors(spark, sf).select("ID", "Cluster", array_to_vector("features").alias("features"))
    proj, ratios = G.pca_2d(vec, keep=["ID", "Cluster"])
    return proj.withColumn("explained_variance_ratio", F.lit(sum(ratios)))
