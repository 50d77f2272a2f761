
from __future__ import annotations

from marketlens.plans import q_classify, q_models, q_outputs, q_prep, q_prepare, q_recommend, q_segment  # noqa: F401
from marketlens.plans.oracle import sql_with
from marketlens.plans.registry import register
from marketlens.sources.profile import customer_profile

register("build_customer_profile", sql_with("SELECT * FROM customer_profile", "customer_profile"))(
    lambda spark, sf: customer_profile(spark, sf))
