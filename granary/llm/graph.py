"""Connected components over an edge table, as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, written


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node it reaches.

    Each round takes the smallest label among a node's neighbours (a grouped minimum, which
    Spark combines before the shuffle) and then the label of that label, so paths halve.
    Rounds are written tables: no lineage grows, and nothing but one count reaches the driver.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    both = written(e.union(e.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n1")).agg(F.min("label").alias("seen"))
        step = labels.join(near, F.col("node") == F.col("n1")).select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        up = step.select(F.col("node").alias("n2"), F.col("label").alias("above"))
        new = written(step.join(up, F.col("label") == F.col("n2"), "left").select("node", "old", F.coalesce(F.least("label", "above"), "label").alias("label")))
        discard(labels)
        labels = new
        if new.where("label < old").isEmpty():
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
