"""Customer marketing analytics on Spark.

Every operator takes and returns DataFrames keyed by the customer ``ID``.
Sub-packages:

* ``sources``   -- star-schema tables, the derived customer profile, file sinks
* ``functions`` -- column expressions (null-skipping row sums, safe division, ranking helpers)
* ``operators`` -- features, cleaning, preprocessing, splits, models, evaluation,
                   segmentation and recommendation
* ``plans``     -- the registry of named queries and their DuckDB oracle SQL
* ``streaming`` -- micro-batch scoring of new customers with a fitted recommender
"""

from marketlens.session import get_spark, ensure_checkpoint_dir  # noqa: F401
