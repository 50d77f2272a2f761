"""Structured Streaming scoring of arriving customer files (M13 per micro-batch)."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from marketlens.operators import recommender as M
from marketlens.plans.q_prepare import profile, reg_prepared
from marketlens.sources import files
from marketlens.streaming.scoring import fit_recommender, start_scoring_stream


def test_stream_scores_every_arriving_customer_like_batch(spark):
    run = fit_recommender(reg_prepared(spark, SF_SMALL))
    src = files.scratch_path(spark, "stream_in")
    # some customers without a marital status: the fill value is the fitted one, whatever arrives together
    prof = profile(spark, SF_SMALL).withColumn("Marital_Status", F.when(F.col("ID") % 5 != 0, F.col("Marital_Status")))
    prof.repartition(3).write.parquet(src)
    sink, ckpt = files.scratch_path(spark, "stream_out"), files.scratch_path(spark, "stream_ckpt")
    q = start_scoring_stream(spark, src, run, sink, ckpt, max_files_per_trigger=1)
    q.awaitTermination()
    streamed = spark.read.parquet(sink)
    batch = M.score_customers(prof, run)
    assert prof.filter(F.col("Marital_Status").isNull()).count() > 0
    cols = ["ID", "Recommended_Product", "Banner_Ad_Order"]
    assert streamed.count() == batch.count()
    assert streamed.select(*cols).exceptAll(batch.select(*cols)).count() == 0
