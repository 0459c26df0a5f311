"""Connected components of a link table, by joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import hot_join, hot_keys, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for all nodes of ``links`` (a, b): the smallest node of each component.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so
    that the rounds are about the logarithm of the longest chain. Labels only fall; it ends when none does. Nodes with very many
    neighbours and labels of very many nodes are salted (``hot_join``). Loops and repeated links change nothing; no links give no rows.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    hubs = hot_keys(both.groupBy("b").agg(F.count(F.lit(1)).alias("w_rows")), ["b"])
    while True:
        seen = hot_join(both, labels.withColumnRenamed("node", "b"), ["b"], hot=hubs, known=True).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        closer = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        closer = written(closer, "labels")
        jump = closer.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = written(hot_join(closer, jump, ["label"]).select("node", "old", F.least("label", "far").alias("label")), "labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
