"""Connected components of a large link table by minimum-label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.session import materialise
from groundwork.sizing import fits


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has a link. `links` has a, b.

    Each round takes the smallest label among neighbours and then the label of that label, and is
    written to the shared folder, so a lost executor costs one round at most. Neighbours are reduced by
    partial aggregation; a node with very many links is split by the skew handling of adaptive joins.
    A table of labels is sent to the tasks only where its rows are proven few: its file may be far smaller.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m"))
                         .select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    few = fits(labels)  # every round has as many

    def side(df: DataFrame) -> DataFrame:
        return df if few else df.hint("merge")

    while True:
        near = both.join(side(labels), both.b == labels.node).groupBy("a").agg(F.min("root").alias("m"))
        pulled = labels.join(side(near), labels.node == near.a).select(
            "node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = pulled.select(F.col("node").alias("parent"), F.col("root").alias("top"))
        new = materialise(pulled.join(side(up), pulled.root == up.parent)
                          .select("node", "old", F.least("root", "top").alias("root")))
        labels = new.select("node", "root")
        if new.filter(F.col("old") != F.col("root")).isEmpty():
            return labels
