"""M2 / M3: logistic regression by Newton steps, all folds and weightings in the same scans.

A fit is a training subset (a set of cells of rows), a weight for each class and a design: its features are linear in base columns ``z`` that all
fits share (:mod:`marketlens.operators.fold_moments`).  One pass returns, for every open fit, the weighted sums ``Z'WZ``, ``Z'(p - y)`` and the loss at its present
coefficients -- a few thousand numbers for each task, added up in the JVM -- and the driver maps them into the fit's own features, adds the penalty and solves.  Newton steps converge
quadratically, so some eight passes serve any number of fits.  A step that raises the loss is halved.

The objective is that of the published setting (C = 1): ``sum of weighted log losses + |w|^2 / 2``, the intercept free.
"""

from __future__ import annotations

from collections.abc import Collection, Hashable, Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.rowexpr import double

#: Largest component of the gradient of the mean loss at which a fit ends.
TOLERANCE = 1e-11
MAX_STEPS = 50


@dataclass
class LogisticModel:
    coefficients: np.ndarray
    intercept: float
    steps: int = 0
    gradient: float = 0.0

    def score(self, features: Column) -> Column:
        """Probability of class 1 of an ``array<double>`` column."""
        weights = F.expr(f"array({', '.join(double(w) for w in self.coefficients)})")
        eta = F.aggregate(F.zip_with(features, weights, lambda x, w: x * w), F.lit(float(self.intercept)), lambda s, v: s + v)
        return 1.0 / (1.0 + F.exp(-eta))

    def transform(self, rows: DataFrame, label: str, features: str = "features") -> DataFrame:
        """``ID, label, prediction, score``; class 1 above one half."""
        x = F.col(features) if rows.schema[features].dataType.typeName() == "array" else vector_to_array(features)
        s = self.score(x)
        return rows.select("ID", label, (s > 0.5).cast("int").alias("prediction"), s.alias("score"))


@dataclass
class Fit:
    """One logistic fit: its rows, the weights of classes 0 and 1, and its features in base columns (base x features; the first base column is 1)."""

    cells: Collection[int]
    weights: tuple[float, float]
    design: np.ndarray
    penalty: float = 1.0
    beta: np.ndarray = field(init=False)  # intercept first

    def __post_init__(self):
        self.beta = np.zeros(self.design.shape[1] + 1)

    def theta(self) -> np.ndarray:
        """Coefficients of the base columns."""
        t = self.design @ self.beta[1:]
        t[0] += self.beta[0]
        return t


def _pass_fn(theta: dict, cells: dict, weights: dict, order: list, size: int):
    def run(batches):
        import pandas as pd
        sums = [np.zeros(size * size + size + 2) for _ in order]
        for pdf in batches:
            if not len(pdf):
                continue
            z = np.concatenate([np.ones((len(pdf), 1)), np.stack(pdf["z"].to_numpy()).astype(float).reshape(len(pdf), -1)], axis=1)
            y, cell = pdf["y"].to_numpy().astype(float), pdf["cell"].to_numpy()
            for s, name in zip(sums, order):
                own = np.isin(cell, cells[name])
                if not own.any():
                    continue
                zo, yo = z[own], y[own]
                eta = zo @ theta[name]
                p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
                w = np.where(yo == 1, weights[name][1], weights[name][0])
                s[:size * size] += ((zo * (w * p * (1 - p))[:, None]).T @ zo).ravel()
                s[size * size:-2] += zo.T @ (w * (p - yo))
                s[-2] += (w * (np.logaddexp(0.0, eta) - yo * eta)).sum()
                s[-1] += len(zo)
        yield pd.DataFrame({"s": [np.concatenate(sums).tolist()]})
    return run


def _statistics(rows: DataFrame, fits: Mapping[Hashable, Fit], size: int) -> dict:
    order = list(fits)
    run = _pass_fn({n: f.theta() for n, f in fits.items()}, {n: sorted(f.cells) for n, f in fits.items()}, {n: f.weights for n, f in fits.items()}, order, size)
    flat = rows.mapInPandas(run, "s array<double>").select(Summarizer.sum(array_to_vector("s")).alias("s")).first()["s"].toArray()
    out = {}
    for name, part in zip(order, flat.reshape(len(order), -1)):
        out[name] = part[:size * size].reshape(size, size), part[size * size:-2], part[-2], part[-1]
    return out


def fit_many(rows: DataFrame, fits: Mapping[Hashable, Fit], max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> dict[Hashable, LogisticModel]:
    """Models of all ``fits`` on ``rows`` (``cell long, z array<double>, y``; stored, as it is read once a step).

    ``z`` leaves out the leading 1.  After ``max_steps`` steps the present coefficients are returned.
    """
    size = next(iter(fits.values())).design.shape[0] if fits else 0
    done: dict[Hashable, LogisticModel] = {}
    before: dict[Hashable, tuple[float, np.ndarray]] = {}
    steps = dict.fromkeys(fits, 0)
    for turn in range(max_steps + 1):
        open_fits = {n: f for n, f in fits.items() if n not in done}
        if not open_fits:
            break
        for name, (g, r, loss, n) in _statistics(rows, open_fits, size).items():
            fit = fits[name]
            extended = np.concatenate([np.eye(size)[:, :1], fit.design], axis=1)
            ridge = np.concatenate([[0.0], np.full(fit.design.shape[1], fit.penalty)])
            value = loss + 0.5 * (ridge * fit.beta ** 2).sum()
            gradient = extended.T @ r + ridge * fit.beta
            worst = float(np.abs(gradient).max()) / max(n, 1.0)
            if worst <= tolerance or turn == max_steps or not n:
                done[name] = LogisticModel(fit.beta[1:].copy(), float(fit.beta[0]), steps[name], worst)
                continue
            if name in before and value > before[name][0] + 1e-9 * abs(before[name][0]):
                fit.beta = (fit.beta + before[name][1]) / 2
                continue
            before[name] = value, fit.beta.copy()
            hessian = extended.T @ g @ extended + np.diag(ridge)
            fit.beta = fit.beta - np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            steps[name] += 1
    return {n: done[n] for n in fits}
