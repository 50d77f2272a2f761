"""Least squares for every fold and split from one scan.

The rows are described by *base terms* that no fit enters: 1, each numeric column (log1p where asked, moved and scaled by fixed figures of
the whole table, 0 where null), an indicator of its nulls, and an indicator for each level of each category (and for its nulls).
The preprocessed features of any training subset -- median for nulls, own mean and deviation, most frequent level -- are affine in those terms,
and degree-2 features are quadratic.  So the sums of products of the terms (or of their products, for degree 2), kept for each
*cell* of rows (fold and side of the split), give everything by arithmetic on the driver: a subset's constants, its normal equations, and
the squared errors of its model on the cells left out.  A fold's fit is the total minus the fold.

One pass returns ``monomials x (monomials + targets)`` numbers for each task and cell, added up in the JVM, whatever the number of rows; medians of all
subsets come from :mod:`marketlens.functions.quantiles`.  Products that are zero by definition (two levels of one category, a
value and its own null indicator) have no monomial.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Hashable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.quantiles import end_columns, quantiles_by_group
from marketlens.functions.rowexpr import double, quoted, text
from marketlens.operators.prep import MAX_LEVELS, ZERO_SCALE, FittedPreprocessor

#: Monomials whose products are summed; more are an error (use fewer columns or levels).
MAX_MONOMIALS = 2000


@dataclass
class Terms:
    """Base terms of a table and the monomials made of them."""

    log_numeric: list[str]
    numeric: list[str]
    categorical: list[str]
    centre: dict[str, float]
    spread: dict[str, float]
    nulls: set[str]
    levels: dict[str, list]
    degree2: bool = True
    ends: dict[str, tuple] | None = None  # smallest and largest raw value of the numeric columns

    def __post_init__(self):
        # (kind, column, level): "1", value, null indicator, level
        self.base: list[tuple] = [("1", None, None)]
        self.base += [("v", c, None) for c in [*self.log_numeric, *self.numeric]]
        self.base += [("m", c, None) for c in [*self.log_numeric, *self.numeric, *self.categorical] if c in self.nulls]
        self.base += [("d", c, lv) for c in self.categorical for lv in self.levels[c]]
        self.place = {t: i for i, t in enumerate(self.base)}
        size = len(self.base)
        self.product = np.full((size, size), -1)  # monomial of a product of two base terms; -1: zero
        self.monomials: list[tuple[int, int]] = []
        for b in range(size):
            self._add(0, b)
        if self.degree2:
            for a in range(1, size):
                for b in range(a, size):
                    self._add(a, b)
        if len(self.monomials) > MAX_MONOMIALS:
            raise ValueError(f"{len(self.monomials)} products of columns are more than {MAX_MONOMIALS}")

    def _add(self, a: int, b: int) -> None:
        (ka, ca, la), (kb, cb, lb) = self.base[a], self.base[b]
        if a and ca == cb and a != b:
            return  # value and null indicator, level and null indicator, or two levels of one column
        if a == b and ka in ("m", "d"):  # an indicator is its own square
            self.product[a, a] = self.product[0, a]
            return
        self.product[a, b] = self.product[b, a] = len(self.monomials)
        self.monomials.append((a, b))

    def array(self) -> Column:
        """The base terms without the 1, as an array of doubles."""
        out = []
        for kind, c, level in self.base[1:]:
            if kind == "v":
                x = f"cast({quoted(c)} as double)"
                x = f"log1p({x})" if c in self.log_numeric else x
                out.append(f"coalesce(({x} - {double(self.centre[c])}) / {double(self.spread[c])}, 0D)")
            elif kind == "m":
                out.append(f"cast({quoted(c)} is null as double)")
            else:
                out.append(f"coalesce(cast({quoted(c)} = {text(level)} as double), 0D)")
        return F.expr(f"array({', '.join(out)})")


def table_terms(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (), log_numeric: Sequence[str] = (),
                degree2: bool = True, max_levels: int = MAX_LEVELS) -> Terms:
    """Terms of ``df``: two small aggregates tell centre, spread, nulls and levels."""
    log_numeric, numeric, categorical = list(log_numeric), list(numeric), list(categorical)
    nums = log_numeric + numeric
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(nums):
        x = F.col(c).cast("double")
        x = F.log1p(x) if c in log_numeric else x
        low, high = end_columns(c)
        aggs += [F.count(x).alias(f"c{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"), low.alias(f"l{i}"), high.alias(f"h{i}")]
    aggs += [F.count(c).alias(f"k{i}") for i, c in enumerate(categorical)]
    row = df.agg(*aggs).first()
    centre = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(nums)}
    spread = {c: row[f"s{i}"] if row[f"s{i}"] and row[f"s{i}"] >= ZERO_SCALE else 1.0 for i, c in enumerate(nums)}
    nulls = {c for i, c in enumerate(nums) if row[f"c{i}"] < row["n"]} | {c for i, c in enumerate(categorical) if row[f"k{i}"] < row["n"]}
    levels: dict[str, list] = {c: [] for c in categorical}
    if categorical:
        cells = F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("level")) for c in categorical]))
        seen = df.select(cells).where("level is not null").distinct().limit(max_levels * len(categorical) + 1).collect()
        for r in seen:
            levels[r["c"]].append(r["level"])
        for c, found in levels.items():
            if len(found) > max_levels:
                raise ValueError(f"{c} has more than {max_levels} levels")
            found.sort()
    ends = {c: (row[f"l{i}"], row[f"h{i}"]) for i, c in enumerate(nums)}
    return Terms(log_numeric, numeric, categorical, centre, spread, nulls, levels, degree2, ends)


@dataclass
class Moments:
    """Sums of products over some rows: monomials with monomials (``g``), with targets (``h``), and targets squared (``yy``)."""

    g: np.ndarray
    h: np.ndarray
    yy: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.g + other.g, self.h + other.h, self.yy + other.yy)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.g - other.g, self.h - other.h, self.yy - other.yy)

    @property
    def n(self) -> float:
        return float(self.g[0, 0])


def _moment_fn(left: np.ndarray, right: np.ndarray, n_targets: int):
    m = len(left)
    upper = np.triu_indices(m)

    def run(batches):
        import pandas as pd
        sums: dict[int, list] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            z = np.concatenate([np.ones((len(pdf), 1)), np.stack(pdf["z"].to_numpy()).astype(float).reshape(len(pdf), -1)], axis=1)
            w = z[:, left] * z[:, right]
            y = np.stack(pdf["y"].to_numpy()).astype(float).reshape(len(pdf), n_targets)
            cell = pdf["cell"].to_numpy()
            for c in np.unique(cell).tolist():
                own = cell == c
                g, h, yy = sums.setdefault(c, [np.zeros((m, m)), np.zeros((m, n_targets)), np.zeros(n_targets)])
                g += w[own].T @ w[own]
                h += w[own].T @ y[own]
                yy += (y[own] ** 2).sum(axis=0)
        yield pd.DataFrame({"cell": list(sums), "s": [np.concatenate([g[upper], h.ravel(), yy]).tolist() for g, h, yy in sums.values()]})
    return run


def cell_moments(df: DataFrame, terms: Terms, targets: Sequence[str], cell: Column) -> dict[int, Moments]:
    """Sums of products for every cell, in one scan."""
    left, right = (np.array([m[i] for m in terms.monomials]) for i in (0, 1))
    m, q = len(left), len(targets)
    rows = df.select(cell.cast("long").alias("cell"), terms.array().alias("z"), F.array(*[F.col(t).cast("double") for t in targets]).alias("y"))
    told = rows.mapInPandas(_moment_fn(left, right, q), "cell long, s array<double>")
    out = {}
    upper = np.triu_indices(m)
    for r in told.groupBy("cell").agg(Summarizer.sum(array_to_vector("s")).alias("s")).collect():
        flat = r["s"].toArray()
        g = np.zeros((m, m))
        g[upper] = flat[:len(upper[0])]
        g = g + np.triu(g, 1).T
        rest = flat[len(upper[0]):]
        out[r["cell"]] = Moments(g, rest[:m * q].reshape(m, q), rest[m * q:])
    return out


def total(moments: Mapping[int, Moments], cells: Collection[int]) -> Moments:
    found = [moments[c] for c in sorted(cells) if c in moments]
    if not found:
        raise ValueError("no rows in these cells")
    out = found[0]
    for m in found[1:]:
        out = out + m
    return out


def fitted_preprocessor(terms: Terms, rows: Moments, medians: Mapping[str, float | None], numeric: Sequence[str], categorical: Sequence[str],
                        log_numeric: Sequence[str]) -> FittedPreprocessor:
    """The constants that :func:`prep.fit_preprocessor` would find on the rows behind ``rows``."""
    fitted = FittedPreprocessor(list(log_numeric), list(numeric), list(categorical))
    n = rows.n
    at = lambda *t: terms.place.get(t)
    for c in [*log_numeric, *numeric]:
        v, m = at("v", c, None), at("m", c, None)
        n_null = rows.g[0, m] if m is not None else 0.0
        med = fitted.medians[c] = medians[c]
        if med is None:
            fitted.means[c], fitted.scales[c] = 0.0, 1.0
            continue
        fill = ((math.log1p(med) if c in terms.log_numeric else med) - terms.centre[c]) / terms.spread[c]
        mean = (rows.g[0, v] + n_null * fill) / n
        var = (rows.g[v, v] + n_null * fill * fill) / n - mean * mean
        sd = math.sqrt(max(var, 0.0)) * terms.spread[c]
        fitted.means[c] = terms.centre[c] + terms.spread[c] * mean
        # sums of squares cannot tell a deviation below their own rounding from none
        constant = sd < ZERO_SCALE or var < 1e-13 * max(1.0, mean * mean)
        fitted.scales[c] = 1.0 if constant else sd
    for c in categorical:
        counts = {lv: rows.g[0, at("d", c, lv)] for lv in terms.levels[c]}
        counts = {lv: k for lv, k in counts.items() if k > 0.5}
        fitted.modes[c] = min(counts, key=lambda lv: (-round(counts[lv]), lv), default=None)
        fitted.levels[c] = sorted(counts)
    return fitted


def design(terms: Terms, fitted: FittedPreprocessor, degree2: bool) -> np.ndarray:
    """The fitted features in monomials: ``monomials x features``, in the order of ``fitted.output_names`` (or its degree-2 terms)."""
    columns = []
    for c in [*fitted.log_numeric, *fitted.numeric]:
        x = np.zeros(len(terms.base))
        if fitted.medians[c] is not None:
            scale = fitted.scales[c]
            x[0] = (terms.centre[c] - fitted.means[c]) / scale
            x[terms.place["v", c, None]] = terms.spread[c] / scale
            m = terms.place.get(("m", c, None))
            if m is not None:
                fill = math.log1p(fitted.medians[c]) if c in terms.log_numeric else fitted.medians[c]
                x[m] = (fill - terms.centre[c]) / scale
        columns.append(x)
    for c in fitted.categorical:
        m = terms.place.get(("m", c, None))
        for lv in fitted.levels[c]:
            x = np.zeros(len(terms.base))
            x[terms.place["d", c, lv]] = 1.0
            if m is not None and fitted.modes[c] == lv:
                x[m] = 1.0
            columns.append(x)
    a = np.stack(columns, axis=1)
    first = np.zeros((len(terms.monomials), a.shape[1]))
    first[terms.product[0]] = a
    if not degree2:
        return first
    known = terms.product >= 0
    out = []
    for j in range(a.shape[1]):
        out.append(first[:, j:j + 1])
        both = a[:, None, :j + 1] * a[None, :, j, None]  # base x base x (i <= j)
        pairs = np.zeros((len(terms.monomials), j + 1))
        np.add.at(pairs, terms.product[known], both[known])
        out.append(pairs)
    return np.concatenate(out, axis=1)


@dataclass
class NormalEquations:
    """Centred products of a design over some rows."""

    n: float
    sxx: np.ndarray
    sxy: np.ndarray
    mean_x: np.ndarray
    mean_y: np.ndarray


def normal_equations(rows: Moments, b: np.ndarray) -> NormalEquations:
    n = rows.n
    mx, my = b.T @ rows.g[:, 0] / n, rows.h[0] / n
    sxx = b.T @ rows.g @ b - n * np.outer(mx, mx)
    return NormalEquations(n, (sxx + sxx.T) / 2, b.T @ rows.h - n * np.outer(mx, my), mx, my)


def errors(rows: Moments, b: np.ndarray, coef: np.ndarray, intercept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared errors of the linear model on these rows and squared deviations from the mean, by target."""
    w = b @ coef
    w[0] += intercept
    sse = rows.yy - 2 * (w * rows.h).sum(axis=0) + (w * (rows.g @ w)).sum(axis=0)
    return np.maximum(sse, 0.0), np.maximum(rows.yy - rows.h[0] ** 2 / rows.n, 0.0)


def group_medians(df: DataFrame, cols: Sequence[str], groups: Mapping[Hashable, Collection[int]], cell: Column, stored: bool = True,
                  ends: Mapping[str, tuple] | None = None) -> dict:
    """Exact median of every column in every group of cells."""
    found = quantiles_by_group(df, cols, (0.5,), groups, cell, stored, ends)
    return {g: {c: v[0] for c, v in by_col.items()} for g, by_col in found.items()}
