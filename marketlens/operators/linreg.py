"""Multi-output least squares from one Gramian pass.

Every task reduces its rows (Arrow batches, NumPy) to the sufficient
statistics ``n, sum x, sum y, X'X, X'Y``; ``Summarizer.sum`` adds the
per-task vectors in the JVM.  Only the (p + q) x p statistics -- independent
of the row count -- reach the driver, where the centred normal equations are
solved with an eigen-decomposition pseudo-inverse.  That is the minimum-norm
least-squares answer, which is what matters when the design is collinear
(one-hot blocks with an intercept): plain normal-equation solvers return
another solution of the same fit, whose predictions differ on unseen
category combinations.

All six outputs come from the same pass.  Prediction is one matrix product
per Arrow batch inside the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RCOND = 1e-10  # relative eigenvalue cut-off of the centred Gramian


def _poly2_fn():
    """Degree-2 terms in ``ml.feature.PolynomialExpansion`` order: x_j, then x_i * x_j for i <= j.

    Returned as a closure so task-side code carries it by value: executors need
    NumPy, not this package.
    """
    def poly2(x):
        cols = []
        for j in range(x.shape[1]):
            cols.append(x[:, j:j + 1])
            cols.append(x[:, :j + 1] * x[:, j:j + 1])
        return np.concatenate(cols, axis=1) if cols else x
    return poly2


poly2_numpy = _poly2_fn()


def expanded_dim(p: int, degree2: bool) -> int:
    return p * (p + 3) // 2 if degree2 else p


@dataclass
class LinearModel:
    coef: np.ndarray       # p x q
    intercept: np.ndarray  # q
    targets: list[str]
    degree2: bool = False  # features are expanded to degree-2 terms inside the tasks

    def predict(self, df: DataFrame, features: str = "f", keep: Sequence[str] = ("ID",)) -> DataFrame:
        """Batch matrix product per Arrow batch (coefficients travel with the task: p x q numbers)."""
        keep = list(keep)
        coef, icpt, targets, degree2 = self.coef, self.intercept, list(self.targets), self.degree2
        poly2 = _poly2_fn()
        fields = [f for f in df.schema.fields if f.name in keep]
        schema = T.StructType(fields + [T.StructField(t, T.DoubleType()) for t in targets])

        def run(batches):
            import pandas as pd
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                x = np.stack(pdf[features].to_numpy()).astype(float)
                if degree2:
                    x = poly2(x)
                y = x.reshape(len(pdf), coef.shape[0]) @ coef + icpt
                out = pd.DataFrame({k: pdf[k] for k in keep})
                for j, t in enumerate(targets):
                    out[t] = y[:, j]
                yield out

        return df.select(*keep, features).mapInPandas(run, schema)


def min_norm(sxx: np.ndarray, sxy: np.ndarray) -> np.ndarray:
    """Minimum-norm solution of centred normal equations."""
    vals, vecs = np.linalg.eigh((sxx + sxx.T) / 2)
    keep = vals > RCOND * max(vals.max(), 0.0) if vals.size else np.array([], bool)
    return ((vecs[:, keep] / vals[keep]) @ vecs[:, keep].T) @ sxy


def _partial_stats(p: int, q: int, features: str, targets: Sequence[str], degree2: bool = False):
    size = 1 + p + q + p * p + p * q
    poly2 = _poly2_fn()

    def run(batches):
        acc = np.zeros(size)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[features].to_numpy()).astype(float)
            if degree2:
                x = poly2(x)
            x = x.reshape(len(pdf), p)
            y = pdf[list(targets)].to_numpy(dtype=float).reshape(len(pdf), q)
            acc[0] += len(pdf)
            acc[1:1 + p] += x.sum(axis=0)
            acc[1 + p:1 + p + q] += y.sum(axis=0)
            acc[1 + p + q:1 + p + q + p * p] += (x.T @ x).ravel()
            acc[1 + p + q + p * p:] += (x.T @ y).ravel()
        import pandas as pd
        yield pd.DataFrame({"s": [acc.tolist()]})

    return run, size


def fit_least_squares(df: DataFrame, features: str, targets: Sequence[str], dim: int | None = None,
                      degree2: bool = False) -> LinearModel:
    """Minimum-norm OLS with intercept for all ``targets`` at once.

    ``features`` is an ``array<double>`` (or vector) column of fixed length ``dim``;
    with ``degree2`` the tasks expand it to degree-2 terms (T7) before the
    Gramian, so the JVM projection stays narrow.
    """
    targets = list(targets)
    if df.schema[features].dataType.typeName() != "array":
        df = df.withColumn(features, vector_to_array(features))
    d = df.select(features, *[F.col(t).cast("double") for t in targets])
    base = dim if dim is not None else len(d.select(features).first()[0])
    p = expanded_dim(base, degree2)
    q = len(targets)
    run, size = _partial_stats(p, q, features, targets, degree2)
    parts = d.mapInPandas(run, T.StructType([T.StructField("s", T.ArrayType(T.DoubleType()))]))
    total = parts.select(Summarizer.sum(array_to_vector("s")).alias("t")).first()["t"].toArray()
    n = total[0]
    sx, sy = total[1:1 + p], total[1 + p:1 + p + q]
    xtx = total[1 + p + q:1 + p + q + p * p].reshape(p, p)
    xty = total[1 + p + q + p * p:].reshape(p, q)
    mx, my = sx / n, sy / n
    sxx = xtx - n * np.outer(mx, mx)
    sxy = xty - n * np.outer(mx, my)
    coef = min_norm(sxx, sxy)
    intercept = my - mx @ coef
    return LinearModel(coef, intercept, targets, degree2)
