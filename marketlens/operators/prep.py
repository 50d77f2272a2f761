"""Fit-on-train preprocessing (impute, log, scale, one-hot, degree-2 terms).

``fit_preprocessor`` runs one global aggregate over the training rows (count, mean and population variance of
the non-null values, from which the imputed column's moments follow exactly), a few counting passes for exact
medians (``functions.quantiles``; no value is shuffled), and counts by level for modes and levels.
Only those constants -- a few numbers per column -- reach the driver.  ``transform`` is then a single
projection with the constants as literals: no join, no shuffle, inside
whole-stage codegen, and the fitted object applies unchanged to test folds,
new customers or a stream.

Semantics follow the published pipeline: median imputation with the exact
midpoint for even counts (``ml.feature.Imputer`` is approximate), population
standard deviation (ddof 0; ``ml.feature.StandardScaler`` uses ddof 1) with a
zero deviation scaled by 1, most-frequent imputation with ties to the smallest
value, and dense dummies for every level seen in fit (unseen -> all zeros).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.quantiles import end_columns, exact_quantiles
from marketlens.functions.rowexpr import double, quoted, text
from marketlens.schema import (CATEGORICAL_CANDIDATES, LOG_NUMERIC_CANDIDATES, STANDARD_NUMERIC_CANDIDATES,
                               numeric_and_categorical)
from marketlens.session import materialize


# Levels of one categorical column that may become columns.
MAX_LEVELS = 1000
# A deviation below ten machine epsilons counts as a constant column (divisor 1).
ZERO_SCALE = 10 * 2.220446049250313e-16


@dataclass
class FittedPreprocessor:
    log_numeric: list[str]
    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str | None] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)

    # ---- column expressions (SQL text: one call each, however many constants they hold) ----------------
    def imputed_sql(self, c: str) -> str:
        med = self.medians.get(c)
        x = f"cast({quoted(c)} as double)"
        return x if med is None else f"coalesce({x}, {double(med)})"

    def numeric_sql(self, c: str) -> str:
        x = self.imputed_sql(c)
        if c in self.log_numeric:
            x = f"log1p({x})"
        return f"(({x} - {double(self.means[c])}) / {double(self.scales[c])})"

    def category_sql(self, c: str) -> str:
        mode = self.modes.get(c)
        return f"coalesce({quoted(c)}, {text(mode)})" if mode is not None else quoted(c)

    def output_names(self) -> list[str]:
        names = [*self.log_numeric, *self.numeric]
        for c in self.categorical:
            names += [f"{c}_{lv}" for lv in self.levels[c]]
        return names

    def output_sql(self) -> list[str]:
        exprs = [self.numeric_sql(c) for c in [*self.log_numeric, *self.numeric]]
        for c in self.categorical:
            filled = self.category_sql(c)
            exprs += [f"coalesce(cast({filled} = {text(lv)} as double), 0D)" for lv in self.levels[c]]
        return exprs

    def output_exprs(self) -> list[Column]:
        return [F.expr(e) for e in self.output_sql()]

    def output_array(self) -> Column:
        return F.expr(f"array({', '.join(self.output_sql())})")

    # ---- application ---------------------------------------------------------
    def transform_columns(self, df: DataFrame, keep: Sequence[str] = ("ID",)) -> DataFrame:
        """Named output columns (numeric blocks, then one dummy per level)."""
        return df.select(*keep, *[e.alias(n) for e, n in zip(self.output_exprs(), self.output_names())])

    def transform_long(self, df: DataFrame, key: str = "ID") -> DataFrame:
        """The same values as rows (key, feature, value), in one pass; fits tables whose columns depend on the fit."""
        cells = ", ".join(f"struct({text(n)} as feature, {e} as value)" for e, n in zip(self.output_sql(), self.output_names()))
        return df.select(key, F.inline(F.expr(f"array({cells})")))

    def transform(self, df: DataFrame, keep: Sequence[str] = ("ID",), output: str = "features") -> DataFrame:
        """Same values as one dense ``VectorUDT`` column for MLlib."""
        return df.select(*keep, array_to_vector(self.output_array()).alias(output))

    @property
    def size(self) -> int:
        return len(self.output_names())


def fit_preprocessor(train: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (),
                     log_numeric: Sequence[str] = (), max_levels: int = MAX_LEVELS) -> FittedPreprocessor:
    """Fit T1 (median), X3 (log1p), T3 (scale), T2 (mode), T4 (levels) on ``train``.

    The imputed column is the non-null values plus ``n_null`` copies of the
    median, so its mean and population variance combine exactly from the
    non-null group's count, mean and variance (parallel-variance formula);
    for log columns the same holds on ``log1p`` values.

    The columns are written once, narrow, and read by the aggregates.  A level becomes a column, so more than ``max_levels`` of one column are an error.
    """
    log_numeric, numeric, categorical = list(log_numeric), list(numeric), list(categorical)
    if not (log_numeric or numeric or categorical):
        raise ValueError("nothing to preprocess: the column lists are empty")
    nums = log_numeric + numeric
    train = materialize(train.select(*dict.fromkeys(nums + categorical)))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in nums:
        x = F.col(c).cast("double")
        t = F.log1p(x) if c in log_numeric else x
        low, high = end_columns(c)
        aggs += [F.count(x).alias(f"cnt_{c}"), F.avg(t).alias(f"mu_{c}"), F.var_pop(t).alias(f"var_{c}"), low.alias(f"min_{c}"), high.alias(f"max_{c}")]
    row = train.agg(*aggs).first()
    medians = exact_quantiles(train, nums, stored=True, ends={c: (row[f"min_{c}"], row[f"max_{c}"]) for c in nums})
    levels = _level_counts(train, categorical, max_levels)
    fitted = FittedPreprocessor(log_numeric, numeric, categorical)
    n = row["_n"]
    for c in nums:
        med = medians[c][0]
        fitted.medians[c] = med
        n1, m1, v1 = row[f"cnt_{c}"], row[f"mu_{c}"], row[f"var_{c}"]
        n0 = n - n1
        if n1 == 0:  # nothing to learn from: constant output
            fitted.means[c], fitted.scales[c] = 0.0, 1.0
            continue
        if n0 and med is not None:
            fill = math.log1p(med) if c in log_numeric else float(med)
            mean = (n1 * m1 + n0 * fill) / n
            var = (n1 * (v1 + (m1 - mean) ** 2) + n0 * (fill - mean) ** 2) / n
        else:
            mean, var = m1, v1
        sd = math.sqrt(max(var, 0.0))
        fitted.means[c] = float(mean)
        fitted.scales[c] = sd if sd >= ZERO_SCALE else 1.0
    for c in categorical:
        fitted.modes[c] = min(levels[c], key=lambda lv: (-levels[c][lv], lv), default=None)
        fitted.levels[c] = sorted(levels[c])
    return fitted


def _level_counts(train: DataFrame, categorical: Sequence[str], max_levels: int) -> dict[str, dict[str, int]]:
    """Rows of each level of each column; at most ``max_levels`` + 1 rows of a column reach the driver."""
    counts: dict[str, dict[str, int]] = {c: {} for c in categorical}
    if not categorical:
        return counts
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("level")) for c in categorical]))
    found = train.select(cells).where("level is not null").groupBy("c", "level").agg(F.count(F.lit(1)).alias("n"))
    for r in found.limit((max_levels + 1) * len(categorical)).collect():
        counts[r["c"]][r["level"]] = r["n"]
    for c, levels in counts.items():
        if len(levels) > max_levels:
            raise ValueError(f"{c} has more than {max_levels} levels")
    return counts


def fit_by_dtype(train: DataFrame, columns: Sequence[str]) -> FittedPreprocessor:
    """T5: median+scale on numeric, mode+one-hot on string columns (by dtype)."""
    nums, cats = numeric_and_categorical(train, columns)
    return fit_preprocessor(train, numeric=nums, categorical=cats)


def fit_stage(train: DataFrame, stage_features: Sequence[str],
              log_candidates: Sequence[str] = LOG_NUMERIC_CANDIDATES,
              standard_candidates: Sequence[str] = STANDARD_NUMERIC_CANDIDATES,
              categorical_candidates: Sequence[str] = CATEGORICAL_CANDIDATES) -> FittedPreprocessor:
    """Log-numeric / plain numeric / categorical blocks picked from candidate lists."""
    feats = list(stage_features)
    return fit_preprocessor(train,
                            numeric=[c for c in standard_candidates if c in feats],
                            categorical=[c for c in categorical_candidates if c in feats],
                            log_numeric=[c for c in log_candidates if c in feats])


def poly2_names(names: Sequence[str]) -> list[str]:
    """Term names in ``ml.feature.PolynomialExpansion(degree=2)`` order."""
    out = []
    for j, b in enumerate(names):
        out.append(b)
        out += [f"{names[i]}*{b}" for i in range(j + 1)]
    return out


def poly2_columns(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ("ID",)) -> DataFrame:
    """T7 as named columns: every x_i and x_i * x_j (i <= j), no bias term."""
    exprs = []
    for j, b in enumerate(cols):
        exprs.append(F.col(b).alias(b))
        exprs += [(F.col(cols[i]) * F.col(b)).alias(f"{cols[i]}*{b}") for i in range(j + 1)]
    return df.select(*keep, *exprs)
