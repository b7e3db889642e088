"""Connected components of an edge table by least labels and pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, of_tiny, written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, null-free) -> node, label: the least node that can be reached. Each round is written to the
    shared folder; rounds grow with the logarithm of the longest chain."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", True)
    labels = written(both.groupBy("a").agg(F.min("b").alias("_least")).select(F.col("a").alias("node"), F.least("a", "_least").alias("label")), "labels", True)
    while True:
        # What the neighbours have, then what the label's own node has.
        offered = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("_offer"))
        lower = labels.join(offered, labels["node"] == offered["a"]).select("node", "label", F.least("label", "_offer").alias("_new"))
        target = labels.select(F.col("node").alias("_at"), F.col("label").alias("_jump"))
        jumped = written(of_tiny(lower, both, labels).join(target, F.col("_new") == F.col("_at"), "left").select("node", F.least(F.col("_new"), F.coalesce("_jump", "_new")).alias("label"), (F.least(F.col("_new"), F.coalesce("_jump", "_new")) != F.col("label")).alias("_changed")), "labels", True)
        discard(labels)
        done = jumped.where("_changed").isEmpty()
        labels = jumped.select("node", "label")
        labels.written_path, labels.tiny = jumped.written_path, jumped.tiny
        if done:
            discard(both)
            return labels
