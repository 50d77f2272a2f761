"""Connected components by repeated contraction.

Each round gives every node the least of itself and its neighbours in a hashed order, and draws edges
between those instead.  Chains and stars shrink alike, so a few rounds do; each is an aggregate and
two joins on written tables, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``edges``; the component is one of its nodes.

    Loops, repeated edges and nulls are allowed; an empty table gives none.
    """
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct()
    edges = written(edges, "edges")
    rounds = []
    while True:
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.min(key("b")), F.first(key("a")))["id"]
        parents = written(ends.groupBy("a").agg(least.alias("parent")).select(F.col("a").alias("node"), "parent"), "parents")
        # one more step up: the parent's parent
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        parents = written(parents.join(up, "parent").select("node", F.col("above").alias("parent")), "parents")
        rounds.append(parents)
        to_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        to_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = written(edges.join(to_a, "a").join(to_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
                        .where("a <> b").distinct(), "edges")
        if edges.isEmpty():
            break
    labels = rounds.pop().select("node", F.col("parent").alias("component"))
    while rounds:
        step = rounds.pop()
        above = labels.select(F.col("node").alias("parent"), "component")
        labels = (step.join(above, "parent", "left")
                  .select("node", F.coalesce("component", "parent").alias("component")))
    return written(labels, "components")
