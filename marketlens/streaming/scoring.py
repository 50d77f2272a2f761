"""Structured Streaming: score arriving customer rows with a fitted recommender.

The published workflow has no streaming operators; its serving path
(``recommend_customers``) is a per-row application of a fitted model, which
is what a stream of new customers needs.  Each micro-batch is prepared with
the batch semantics (age / income filters, rare-status grouping, and for a missing
marital status the value fitted with the model, so that results do not depend on
how rows fall into micro-batches), scored, and written to ``<sink>/epoch=<id>`` with overwrite, so a replayed epoch after a failure
replaces its own output (idempotent sink); progress lives in the
checkpoint location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators import features as P
from marketlens.operators import recommend as R
from marketlens.operators import recommender as M
from marketlens.operators.saved import load_run
from marketlens.schema import CUSTOMER_SCHEMA, PRODUCT_COLUMNS, STAGE_FEATURE_SETS
from marketlens.session import materialize


def fit_recommender(prepared: DataFrame, stage: str = "Existing-customer", model: str = M.LINEAR) -> M.RecommendationRun:
    """One stage x model recommender fitted on the training split (prior from train shares)."""
    data = materialize(M.prepared_targets(prepared))
    train = data.filter(~F.col("is_test"))
    sm = M.fit_stage_model(train, stage, STAGE_FEATURE_SETS[stage], model)
    prior = R.fitted_prior(train, PRODUCT_COLUMNS)
    return M.RecommendationRun(None, (stage, model), None, {(stage, model): sm}, prior, None, P.mode_category(prepared))  # type: ignore[arg-type]


def start_scoring_stream(spark: SparkSession, source_dir: str, run: M.RecommendationRun | str, sink_dir: str,
                         checkpoint_dir: str, available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream; returns the ``StreamingQuery``.  ``run`` is a fitted comparison or the folder where one was saved."""
    run = load_run(spark, run) if isinstance(run, str) else run
    reader = spark.readStream.schema(CUSTOMER_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        scored = M.score_customers(batch, run)
        scored.write.mode("overwrite").parquet(f"{sink_dir}/epoch={epoch_id}")

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
