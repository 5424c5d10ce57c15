"""Connected components of a table of links, by labels that shrink and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spool import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b); the root is the least node of its component.

    Each round takes the least label of all neighbours, then the label that this
    one had; rounds grow with the logarithm of the longest chain.  A node of very
    many links is aggregated by each task first, and its links are joined by
    sort-merge, which splits such partitions.
    """
    both = cut(links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.*").distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = near.join(label, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = cut(step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")), skewed=True)
        changed = new.where("root <> old").limit(1).count()
        label = new.select("node", "root")
        if not changed:
            return label
