"""Connected components of an edge table, by smallest labels and pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.runtime import BROADCAST_ROWS, forget, saved


def components(edges: DataFrame, name: str = "components", rows: int | None = None) -> DataFrame:
    """rows: about how many edges, for the number of files. edges (a, b) to (node, label): label is the smallest node of the component. Every step sends each node's least
    label along the edges (pre-aggregated minima, so a node with many edges sends one row per task) and then follows labels of
    labels. Tables are written to the shared folder; a step depends on the last one alone."""
    spark = edges.sparkSession
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{name}-edges", rows)
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}-labels", rows)
    # a label is two numbers: up to BROADCAST_ROWS of them are sent to where they are needed, more are joined by a shuffle
    nodes = labels.count()
    sent, rows = F.broadcast if nodes <= BROADCAST_ROWS else (lambda df: df), nodes
    while True:
        told = sent(labels)
        heard = both.join(told, both["b"] == told["node"]).groupBy(both["a"].alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(sent(heard), "node", "left").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("was"))
        jump = sent(near.select(F.col("node").alias("via"), F.col("label").alias("far")))
        after = saved(near.join(jump, F.col("label") == F.col("via"), "left").select("node", F.least("label", "far").alias("label"), "was"), f"{name}-labels", rows)
        changed = after.filter("label <> was").limit(1).count()
        forget(spark, labels)
        labels = after.drop("was")
        if not changed:
            forget(spark, both)
            return labels
