"""Connected components of an edge table, without moving it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.scratch import materialise, release

#: Label propagation with pointer jumping needs about the logarithm of the longest path.
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, component), the smallest node reachable, for nodes with an edge.

    Every round takes the smallest label among the neighbours and then the label of that label, so
    stars settle at once and paths halve. Labels are written out each round; only "has anything
    changed" returns to the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = materialise(both, "graph-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "graph-labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("other")), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "other").alias("component"))
        target = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = step.join(target, "component", "left")
        older, labels = labels, materialise(jumped.select("node", "was", F.least("component", "further").alias("component")), "graph-labels")
        release(older)
        if labels.filter("was <> component").isEmpty():
            release(both)
            return labels.select("node", "component")
        labels = labels.select("node", "component")
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
