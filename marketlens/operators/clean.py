"""Row filters of the three workflows and the removed-row count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_classification(min_age: int = 18, max_age: int = 100, max_income: float = 200000) -> Column:
    """F1 predicate: age in range (NULL age dropped), income NULL or capped."""
    return (F.col("Age").between(min_age, max_age)
            & (F.col("Income").isNull() | (F.col("Income") <= max_income)))


def keep_clustering(min_age: int = 18, max_age: int = 100, max_income: float = 200000) -> Column:
    """F2 predicate: F1 and a parseable enrolment date (tenure not NULL)."""
    return keep_classification(min_age, max_age, max_income) & F.col("CustomerTenure").isNotNull()


def clean_classification(df: DataFrame, **bounds) -> DataFrame:
    """F1 on a featured table (needs ``Age`` and ``Income``)."""
    return df.filter(keep_classification(**bounds))


def clean_clustering(df: DataFrame, **bounds) -> DataFrame:
    """F2 on a featured table (needs ``Age``, ``Income``, ``CustomerTenure``)."""
    return df.filter(keep_clustering(**bounds))


def removed_rows(df: DataFrame, keep: Column) -> DataFrame:
    """rows before, rows kept and rows removed, in one aggregate pass."""
    flag = F.coalesce(keep, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("rows_before"),
                  F.count_if(flag).alias("rows_after"),
                  F.count_if(~flag).alias("removed_rows"))
