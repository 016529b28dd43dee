"""Connected components of undirected graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintloom.operators.shared import checkpointed, written

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of each component; edges has columns a and b, nodes without edges do not appear.

    Every round takes the smallest label among a node and its neighbours, gives the
    smallest that nodes of one label have heard to all of them, and then jumps to the
    label of that label, so rounds grow with the logarithm of the longest chain.
    Minima are combined before they are moved, so a node with very many neighbours is spread.
    """
    both = checkpointed(edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component"))
    labels = written(labels)
    for _ in range(MAX_ROUNDS):
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(heard, F.col("node") == F.col("a")).select("node", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        hooked = lower.groupBy("was").agg(F.min("component").alias("m"))
        lower = lower.join(hooked, "was").select("node", F.col("m").alias("component"), "was")
        top = lower.select(F.col("node").alias("component"), F.col("component").alias("top"))
        jumped = lower.join(top, "component").select("node", F.least("component", "top").alias("component"), "was")
        jumped = written(jumped)
        changed = not jumped.where("component <> was").isEmpty()
        labels = jumped.drop("was")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
