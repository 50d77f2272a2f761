"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col_or(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_sum_skip_nulls(cols: Sequence[str | Column]) -> Column:
    """Row sum where a missing cell counts as 0 (pandas ``sum(axis=1)``)."""
    return reduce(lambda a, b: a + b, [F.coalesce(col_or(c), F.lit(0)) for c in cols])


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` with division by zero or a missing operand mapped to 0."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def avg_tie_pct_rank(col: str, partition: Sequence[str] = ()) -> Column:
    """``rank(pct=True)`` with ties averaged: (rank + (ties - 1) / 2) / n."""
    base = Window.partitionBy(*partition) if partition else Window.partitionBy()
    order = base.orderBy(F.col(col))
    ties = base.partitionBy(*partition, col) if partition else Window.partitionBy(col)
    n = F.count(F.lit(1)).over(base)
    return (F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0) / n


def scored_products(score_cols: Sequence[str], names: Sequence[str]) -> Column:
    """Array of ``struct(neg_score, pos, product, score)`` sorted best first.

    Sorting ascending on ``-score`` then on the column position puts the
    highest score first and breaks ties by the fixed product order.
    """
    items = [F.struct((-F.col(c)).alias("neg"), F.lit(i).alias("pos"), F.lit(n).alias("product"),
                      F.col(c).alias("score"))
             for i, (c, n) in enumerate(zip(score_cols, names))]
    return F.array_sort(F.array(*items))


def top1_product(score_cols: Sequence[str], names: Sequence[str]) -> Column:
    """``idxmax(axis=1)``: name of the row maximum, first column on ties."""
    return scored_products(score_cols, names)[0]["product"]


def banner_order(score_cols: Sequence[str], names: Sequence[str]) -> Column:
    """Products joined by `` > `` in descending score."""
    return F.array_join(F.transform(scored_products(score_cols, names), lambda s: s["product"]), " > ")


def banner_scores(score_cols: Sequence[str], names: Sequence[str]) -> Column:
    """``product:score`` (3 decimals) joined by `` | `` in descending score."""
    return F.array_join(
        F.transform(scored_products(score_cols, names),
                    lambda s: F.format_string("%s:%.3f", s["product"], s["score"])),
        " | ")


# ---- pieces of SQL text ------------------------------------------------------------------------------
def double(x: float) -> str:
    """A double literal."""
    return f"({float(x)!r}D)" if math.isfinite(x) else f"cast('{float(x)}' as double)"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"
