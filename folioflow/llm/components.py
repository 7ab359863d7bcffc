"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import checkpointed, release


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): each node of an edge with the smallest node it reaches. Every round a node takes the
    smallest label around it and then the label of its label, so that rounds grow with the logarithm of the longest
    path; labels are checkpointed each round and only the number of changes reaches the driver."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label"))
    labels = held = checkpointed(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        once = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = checkpointed(once.join(jump, "next", "left").select("node", "label", F.least("next", F.coalesce("far", "next")).alias("next")))
        changed = moved.where("label <> next").limit(1).count()
        release(held)
        held, labels = moved, moved.select("node", F.col("next").alias("label"))
        if not changed:
            release(both)
            return labels
