"""What the tracks publish (S5, S6), lookups in it (W9), and scoring from a saved model."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import classify as C, recommend as R, recommender as M, saved, segment as G
from marketlens.plans import q_classify, q_models, q_prepare, q_recommend, q_segment
from marketlens.plans.registry import REGISTRY, register
from marketlens.schema import CLUSTER_FEATURES
from marketlens.sources import files
from marketlens.sources.results import Table, lookup, publish, read_result, versions


def classification_outputs(spark, sf) -> dict[str, Table]:
    pred = q_classify.all_predictions(spark, sf)
    holdout = pred.where(F.col("fold") == -1)
    return {"classification_model_results": Table(C.ranked_models(C.compare_classifiers(pred)), "csv"),
            "confusion_matrices": Table(C.confusion_matrix(holdout), "csv"),
            "classification_reports": Table(C.classification_report(holdout), "json"),
            "prediction_samples": Table(q_classify.q_prediction_samples(spark, sf), "csv"),
            "classification_data_summary": Table(q_prepare.q_dataset_summary(spark, sf), "json"),
            "predictions": Table(pred)}


def clustering_outputs(spark, sf) -> dict[str, Table]:
    labelled = q_segment.kmeans_labelled(spark, sf)
    scores, _ = G.k_selection(q_segment.clu_vectors(spark, sf))
    rows = q_prepare.clu_clean(spark, sf).select("ID", *CLUSTER_FEATURES).join(labelled.select("ID", "Cluster"), "ID")
    return {"clustering_profile": Table(G.profile_with_personas(labelled), "csv"), "clustering_k_scores": Table(scores, "csv"),
            "clustered_customers": Table(rows, key="ID")}


def recommendation_outputs(spark, sf) -> dict[str, Table]:
    run = q_models.run(spark, sf)
    plain = run.summary.withColumnsRenamed({c: c.replace(" ", "_") for c in run.summary.columns})
    return {"regression_summary": Table(plain, "csv"), "recommendation_diagnostics": Table(R.product_diagnostics(run.final_predictions), "csv"),
            "predictions": Table(run.final_predictions, key="ID"), "customer_scores": Table(M.score_customers(q_prepare.profile(spark, sf), run), key="ID")}


TRACKS = {"classification": classification_outputs, "clustering": clustering_outputs, "recommendation": recommendation_outputs}


@register("published_results", note="S5 / S6: the result sets of all three tracks, published and read back (rows of each table)")
def q_published_results(spark, sf):
    root, out = files.scratch_path(spark, "results"), None
    for track, outputs in TRACKS.items():
        folder = f"{root}/{track}"
        publish(spark, folder, outputs(spark, sf))
        for name in versions(spark, folder).popitem()[1]:
            one = read_result(spark, folder, name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(track).alias("track"), F.lit(name).alias("name"), "n_rows")
            out = one if out is None else out.unionByName(one)
    return out


@register("customer_score_lookup", REGISTRY["customer_score_table"].sql, note="W9 as a point lookup: the score table published by key, one customer read")
def q_customer_score_lookup(spark, sf):
    folder = files.scratch_path(spark, "scores")
    frame = q_recommend._stand_in_frame(spark, sf)
    publish(spark, folder, {"scores": Table(frame, key="ID")})
    first = read_result(spark, folder, "scores").agg(F.min("ID")).first()[0]  # from the files' statistics
    return R.customer_score_table(lookup(spark, folder, "scores", first), first).withColumn("rank", F.col("rank").cast("int"))


@register("score_saved_customers", note="M13: a recommender fitted, saved, loaded and applied to every customer")
def q_score_saved_customers(spark, sf):
    path = files.scratch_path(spark, "recommender")
    saved.ShareRecommender().fit(q_prepare.reg_prepared(spark, sf)).write().save(path)
    return saved.ShareRecommenderModel.load(path).transform(q_prepare.profile(spark, sf))
