"""Every registered query of the library runs as registered (those with SQL are compared in test_oracle)."""

import pytest

import __spark_entry__ as entry
from marketlens.plans.registry import REGISTRY

from conftest import SF_SMALL

QUERIES = entry.queries()


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql is None))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.columns and df.count() > 0


def test_queries_with_sql_are_compared():
    assert {n for n, q in REGISTRY.items() if q.sql is not None} <= set(entry.oracle_sql())
