"""M6: exact classification trees, level by level, all folds together.

At each level one pass counts, for every open node of every tree, the rows of each class by distinct (feature, value) -- tasks combine their own
counts first.  Running sums over the sorted values give the classes left of each value (by a window while features have at most ``WINDOW_VALUES`` distinct
values; beyond, range-partitioned with no group in one task), and an aggregate keeps the best split of each node: weighted gini, at least ``min_leaf`` unweighted rows on both sides, ties to the first feature and then the
smaller value.  The threshold is the midpoint to the next distinct value.  Every distinct value is a candidate: nothing is binned.  Only splits and class counts of nodes
reach the driver.

Trees (training subsets) differ in their rows, class weights and fill values for missing features.  A node splits while it is impure, above ``max_depth`` and holds a valid split.
"""

from __future__ import annotations

from collections.abc import Collection, Hashable, Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.ranking import sum_before
from marketlens.functions.rowexpr import double
from marketlens.session import materialize

MAX_DEPTH, MIN_LEAF = 5, 20
#: Distinct values of a node and feature that one task may sort.
WINDOW_VALUES = 200_000


@dataclass
class Tree:
    """Training subset, weights of classes 0 and 1, fill value of each feature, and the nodes found (children of ``i`` are ``2i`` and ``2i + 1``)."""

    cells: Collection[int]
    weights: tuple[float, float]
    fill: np.ndarray
    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    counts: dict[int, tuple[int, int]] = field(default_factory=dict)

    def score_of(self, node: int) -> float:
        zero, one = (c * w for c, w in zip(self.counts[node], self.weights))
        return one / (zero + one) if zero + one else 0.0

    def score_sql(self, node: int = 1) -> str:
        """Weighted share of class 1 in the leaf of the array ``_x``, as nested conditions."""
        if node not in self.splits:
            return double(self.score_of(node))
        i, threshold = self.splits[node]
        low, high = self.score_sql(2 * node), self.score_sql(2 * node + 1)
        return f"if(coalesce(_x[{i}], {double(self.fill[i])}) <= {double(threshold)}, {low}, {high})"

    def transform(self, rows: DataFrame, label: str, features: Column) -> DataFrame:
        """``ID, label, prediction, score``; equal shares are class 0.  ``features`` is the array column that the tree was grown on."""
        found = rows.select("ID", label, features.alias("_x")).select("ID", label, F.expr(self.score_sql()).alias("score"))
        return found.select("ID", label, (F.col("score") > 0.5).cast("int").alias("prediction"), "score")


def _count_fn(trees: list[tuple], open_nodes: list[list[int]]):
    """Counts by (tree, node, feature, value) of the rows in open nodes."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            cell, y, out = batch.column(0).to_numpy(), batch.column(2).to_numpy() == 1, []
            for t, (cells, fill, splits) in enumerate(trees):
                own = np.isin(cell, cells)
                xt, yt = x[own], y[own]
                xt = np.where(np.isnan(xt), fill[None], xt) + 0.0  # -0.0 is 0.0
                node = np.ones(len(xt), np.int64)
                for n in sorted(splits):  # parents before children
                    i, threshold = splits[n]
                    here = node == n
                    node[here] = 2 * n + (xt[here, i] > threshold)
                for n in open_nodes[t]:
                    here = node == n
                    if not here.any():
                        continue
                    for i, column in enumerate(xt[here].T):
                        values, at = np.unique(column, return_inverse=True)
                        ones = np.bincount(at, weights=yt[here], minlength=len(values)).astype(np.int64)
                        both = np.bincount(at, minlength=len(values))
                        out.append((np.full(len(values), t, np.int32), np.full(len(values), n), np.full(len(values), i, np.int32), values, both - ones, ones))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["tree", "node", "feature", "value", "c0", "c1"])
    return run


_COUNTS = "tree int, node long, feature int, value double, c0 long, c1 long"


def _best_splits(values: DataFrame, trees: list[Tree], nodes: list[tuple[int, int]], min_leaf: int, small: bool) -> list:
    """Best split of every node: ``tree, node, feature, at, next`` (value and next value) and the class counts on its left.

    With ``small``, no feature has more than ``WINDOW_VALUES`` distinct values, so a window may number those of one node and feature.
    """
    spark, key = values.sparkSession, ["tree", "node", "feature"]
    known = spark.createDataFrame([(t, n, *trees[t].counts[n], *trees[t].weights) for t, n in nodes], "tree int, node long, n0 long, n1 long, w0 double, w1 double")
    if small:
        along = Window.partitionBy(*key).orderBy("value")
        left = along.rowsBetween(Window.unboundedPreceding, 0)
        sums = values.select(*key, "value", F.sum("c0").over(left).alias("l0"), F.sum("c1").over(left).alias("l1"), F.lead("value").over(along).alias("next"))
    else:
        values = materialize(values)
        before = sum_before(values, key, "value", ["c0", "c1"])
        sums = before.select(*key, "value", (F.col("c0_before") + F.col("c0")).alias("l0"), (F.col("c1_before") + F.col("c1")).alias("l1"),
                             F.lit(None).cast("double").alias("next"))
    left0, left1 = F.col("l0"), F.col("l1")
    right0, right1 = F.col("n0") - left0, F.col("n1") - left1

    def purity(zero: Column, one: Column) -> Column:
        a, b = zero * F.col("w0"), one * F.col("w1")
        return (a * a + b * b) / (a + b)
    judged = (sums.join(F.broadcast(known), ["tree", "node"]).where((left0 + left1 >= min_leaf) & (right0 + right1 >= min_leaf))
              .withColumn("loss", -(purity(left0, left1) + purity(right0, right1))))
    order = F.struct("loss", "feature", F.col("value").alias("at"), "l0", "l1", "next")
    best = judged.groupBy("tree", "node").agg(F.min(order).alias("b")).select("tree", "node", "b.feature", "b.at", "b.l0", "b.l1", "b.next").collect()
    if small or not best:
        return best
    chosen = spark.createDataFrame([r[:6] for r in best], "tree int, node long, feature int, at double, l0 long, l1 long")
    later = values.join(F.broadcast(chosen), key).where(F.col("value") > F.col("at"))
    return later.groupBy(*key, "at", "l0", "l1").agg(F.min("value").alias("next")).collect()


def grow(rows: DataFrame, trees: Mapping[Hashable, Tree], max_depth: int = MAX_DEPTH, min_leaf: int = MIN_LEAF) -> Mapping[Hashable, Tree]:
    """Grow ``trees`` (in place) on ``rows``: ``cell long, x array<double>, y`` (0 or 1); missing features are null.

    ``rows`` is read once a level, so it should be stored.
    """
    min_leaf, made = max(1, min_leaf), list(trees.values())
    rows = rows.select(F.col("cell").cast("long").alias("cell"), F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("x"), F.col("y").cast("int").alias("y"))
    distinct = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.approx_count_distinct("v", 0.02).alias("n")).agg(F.max("n")).first()[0]
    small = (distinct or 0) <= 0.9 * WINDOW_VALUES - len(made)  # fills add a value for each tree
    by_class = [(r["cell"], r["y"], r["n"]) for r in rows.groupBy("cell", "y").agg(F.count(F.lit(1)).alias("n")).collect()]
    for t in made:
        t.counts[1] = tuple(sum(n for cell, y, n in by_class if y == label and cell in t.cells) for label in (0, 1))
    level = [(t, 1) for t in range(len(made))]
    for _ in range(max_depth):
        level = [(t, n) for t, n in level if min(made[t].counts[n]) > 0 and sum(made[t].counts[n]) >= 2 * min_leaf]
        if not level:
            break
        specs = [(sorted(t.cells), t.fill, dict(t.splits)) for t in made]
        open_nodes = [[n for u, n in level if u == t] for t in range(len(made))]
        counted = (rows.mapInArrow(_count_fn(specs, open_nodes), _COUNTS).groupBy("tree", "node", "feature", "value")
                   .agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
        deeper = []
        for r in _best_splits(counted, made, level, min_leaf, small):
            tree, n = made[r["tree"]], r["node"]
            middle = (r["at"] + r["next"]) / 2
            tree.splits[n] = (r["feature"], middle if middle < r["next"] else r["at"])
            tree.counts[2 * n] = (r["l0"], r["l1"])
            tree.counts[2 * n + 1] = (tree.counts[n][0] - r["l0"], tree.counts[n][1] - r["l1"])
            deeper += [(r["tree"], 2 * n), (r["tree"], 2 * n + 1)]
        level = deeper
    return trees
