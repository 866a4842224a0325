"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: Rows of two ids in a file.
ROWS = 1 << 18


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, label) for every node that has a link; label is the component's smallest node.

    Each round takes the smallest label among a node's neighbours and then the label of its label, so that
    the rounds grow with the logarithm of a component's diameter in the usual case; they go on until no label
    changes. Rounds are written to the shared folder: none depends on an executor's memory. Two joins a round, and sums before shuffles."""
    files = -(-2 * links.count() // ROWS)
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links", files)
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels", files)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        to = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = cut(own.join(to, own["label"] == to["_n"], "left").select("node", "was", F.least("label", F.coalesce("_l", F.col("label"))).alias("label")), "labels", files)
        drop_cut(labels)
        labels = new.select("node", "label")
        if new.where("was <> label").isEmpty():
            break
    drop_cut(both)
    return labels
