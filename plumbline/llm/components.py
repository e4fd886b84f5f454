"""Connected components by least labels, all joins and sums in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that can be reached over ``edges`` (a, b). Nodes without an edge do not appear.

    Each round takes the least label among neighbours, then the label of that label, so that long chains shorten by half. A
    hub's edges are only rows of a join and of a combined minimum; no neighbourhood is collected.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        least = labels.join(heard, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("beyond"))
        after = cut_lineage(least.join(jump, "mid").select("node", "old", F.least("mid", "beyond").alias("label")))
        labels = after.select("node", "label")
        if after.filter("old <> label").isEmpty():
            return labels
