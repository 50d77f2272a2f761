"""Columns of vectors: which take part, arrays from Arrow, sums by dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import map_batches


def takes_part(vector: str) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def by_dimension(column) -> dict[int, np.ndarray]:
    """Row indices by vector length."""
    sizes = np.diff(np.asarray(column.offsets))
    return {int(d): np.flatnonzero(sizes == d) for d in np.unique(sizes)}


def means(valid: DataFrame, vector: str) -> dict[int, np.ndarray]:
    """Mean vector for each dimension, over all rows; tasks add up before the shuffle."""

    def run(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for d, rows in by_dimension(batch.column(0)).items():
                had = sums.setdefault(d, [0, np.zeros(d)])
                had[0] += len(rows)
                had[1] += matrix(batch.column(0).take(pa.array(rows))).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()),
             pa.array([s[1] for s in sums.values()], pa.list_(pa.float64()))], names=["d", "n", "s"])

    parts = map_batches(valid.select(F.col(vector).cast("array<double>")), run, "d int, n long, s array<double>")
    total = (parts.select("d", "n", F.posexplode("s").alias("i", "x")).groupBy("d", "i")
             .agg((F.sum("x") / F.sum("n")).alias("m")).groupBy("d").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("m")))
    return {r["d"]: np.array([x["m"] for x in r["m"]]) for r in total.collect()}
