"""Connected components with DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm.durable import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b): comp is the smallest node that a node is connected with.

    Each round takes the smallest label of a node's neighbours and then that
    label's own label, so distances halve; labels are checkpointed each round.
    No edges give no rows; loops and repeated edges change nothing.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("comp").alias("top"))
        new = checkpointed(low.join(up, "low").select("node", "old", F.least("low", "top").alias("comp")))
        labels = new.select("node", "comp")
        if not new.where("old <> comp").limit(1).count():
            return labels
