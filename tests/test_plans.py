"""The profile plan keeps column pruning, filter pushdown and the small-side broadcast."""

import contextlib
import io

from conftest import SF_SMALL
from marketlens.sources.profile import customer_profile


def _formatted_plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_profile_scans_are_pruned_and_filtered(spark):
    plan = _formatted_plan(customer_profile(spark, SF_SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_extendedprice:double,l_discount:double>" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string>" in plan
    assert "EqualTo(event_type,error)" in plan
    assert "BroadcastHashJoin" in plan  # part (two columns) is the broadcast side at this size
    # lineitem is aggregated per order before it meets orders: exactly one aggregate keyed by l_orderkey
    assert plan.count("Keys [1]: [l_orderkey") >= 1
