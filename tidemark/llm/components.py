"""Connected components of links, by minimum labels and pointer jumping, in written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 200) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): label is the smallest node reachable.

    Each round takes the least label among the neighbours, then the label of
    that label; the number of rounds grows with the logarithm of the diameter.
    Nothing of size goes to the driver but the count of changed labels.
    """
    edges = scratch.save(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    labels = scratch.save(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"))
    for _ in range(most_rounds):
        around = edges.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        # A label is a node too, and has itself a label.  Written first, so that a join by label can split one that most nodes have.
        better = scratch.save(labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        roots = better.select(F.col("node").alias("root"), F.col("label").alias("top"))
        jumped = scratch.save(better.join(roots, F.col("label") == F.col("root")).select("node", "old", F.least("label", "top").alias("label")))
        scratch.drop(labels)
        scratch.drop(better)
        labels = jumped
        if not labels.filter(F.col("label") != F.col("old")).limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return labels.select("node", "label")
