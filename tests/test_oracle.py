"""Every SQL-checkable query against its DuckDB oracle (sf0.001: fast; the driver checks sf0.01)."""

import pytest

import __spark_entry__ as entry
from marketlens.plans.verify import compare

from conftest import SF_SMALL

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck_small, name):
    res = compare(QUERIES[name](spark, SF_SMALL), duck_small, SQL[name])
    assert res["columns_match"], res
    assert res["types_match"], res
    assert res["match"], res


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"ID", "Recommended_Product", "Banner_Ad_Order", "Banner_Ad_Scores"} <= set(df.columns)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle_can_be_a_view(duck_small, name):
    """A checker may keep the statement as a view, in either way."""
    duck_small.execute(f"CREATE OR REPLACE TEMP VIEW checked AS {SQL[name]}")
    duck_small.execute("SELECT count(*) FROM checked").fetchall()
    duck_small.sql(SQL[name]).create_view("checked_too", replace=True)
