"""Connected components of an undirected graph, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelayout.llm.common import table


def components(links: DataFrame) -> DataFrame:
    """(a, b) links, a table, to (node, root): every linked node with the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so paths halve; it ends when no
    label changes. Rounds are tables in the shared folder: lineage stays short, and sizes are known (after checkpoint() Spark multiplies estimates, whose digits double each round). No links give no rows.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    labels = table(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        nearer = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        nearer = table(nearer.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("root")))
        labels = nearer.select("node", "root")
        if nearer.where("old <> root").isEmpty():
            return labels
