"""Connected components by minimum labels and pointer jumping, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.shared import drop, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round takes the least label among a node's neighbours and then the label of
    that label, so the rounds grow with the logarithm of a component's diameter; they end when no label changes, as labels only fall.
    Every join is of two written tables, so that Spark can split what a common label or a star's centre makes large.
    No edges: no rows. Loops and repeated edges do no harm; null ends are dropped.
    """
    both = edges.where("a is not null and b is not null").select("a", "b")
    both = written(both.union(both.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))
    table = labels = written(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = written(labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("to")), "step")
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("jumped"))
        new = written(step.join(jump, "to").select("node", "was", F.least("to", "jumped").alias("component")), "labels")
        drop(step, table)
        table, labels = new, new.select("node", "component")
        if new.where("was <> component").isEmpty():
            drop(both)
            return labels
