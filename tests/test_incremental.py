"""The customer table kept up to date against the one built at once."""

import random

import pytest
from pyspark.sql import functions as F

from marketlens.sources.incremental import ProfileState
from marketlens.sources.profile import build_customer_profile
from marketlens.sources.tables import Tables

from conftest import SF_SMALL


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def whole(spark):
    return rows_of(build_customer_profile(Tables(spark, SF_SMALL)))


def slices(spark, n):
    """Every table in ``n`` arbitrary pieces."""
    t = Tables(spark, SF_SMALL)
    cut = lambda df, *c: [df.where(F.pmod(F.xxhash64(*c, F.lit("cut")), F.lit(n)) == i) for i in range(n)]
    pieces = [{"lineitem": d, "part": t.part} for d in cut(t.lineitem, "l_orderkey", "l_linenumber")]
    pieces += [{"orders": d} for d in cut(t.orders, "o_orderkey")] + [{"events": d} for d in cut(t.events, "user_id", "ts" if "ts" in t.events.columns else "user_id")]
    return pieces + [{"customer": d} for d in cut(t.customer, "c_custkey")]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_files_gives_the_full_build(spark, whole, tmp_path, seed):
    pieces = slices(spark, 2)
    random.Random(seed).shuffle(pieces)
    state = ProfileState(spark, str(tmp_path / "state"), buckets=4)
    for i, piece in enumerate(pieces):
        state.apply(**piece)
        if i == 4:
            state.compact()
    assert rows_of(state.profile()) == whole
    again = ProfileState(spark, str(tmp_path / "state"), buckets=99)  # opened again: the folder's number of buckets holds
    assert again.buckets == 4 and rows_of(again.profile()) == whole
    state.compact()
    assert state.table("partials").count() <= len(whole) + 400 and rows_of(state.profile()) == whole


def test_all_at_once_and_a_batch_that_died(spark, whole, tmp_path, monkeypatch):
    t = Tables(spark, SF_SMALL)
    state = ProfileState(spark, str(tmp_path / "state"), buckets=4)
    with monkeypatch.context() as m:
        m.setattr(state, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            state.apply(t.part, t.customer, t.orders, t.lineitem, t.events)
    assert state.profile().count() == 0  # nothing of it counts
    state.apply(t.part, t.customer, t.orders, t.lineitem, t.events)
    assert rows_of(state.profile()) == whole
    with pytest.raises(ValueError, match="parts"):
        state.apply(lineitem=t.lineitem)


def test_buckets_are_not_exchanged(spark, tmp_path):
    t = Tables(spark, SF_SMALL)
    state = ProfileState(spark, str(tmp_path / "state"), buckets=4)
    state.apply(t.part, t.customer, t.orders, t.lineitem, t.events)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = state.profile()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "hashpartitioning" not in plan and "Bucketed: true" in plan
    one = t.orders.where("o_orderkey > 0").limit(1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known = state._known("spend", one, "o_orderkey")
        plan = known.join(one, F.col("l_orderkey") == F.col("o_orderkey"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SelectedBucketsCount: 1 out of 4" in plan
