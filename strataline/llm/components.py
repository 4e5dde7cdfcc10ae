"""Connected components of a link table, without collecting it.

Labels start as the nodes themselves. In each round a node takes the least
label among itself and its neighbours, and then the label that this label had,
so that chains shorten fast; rounds end when no label changes. Both sides of the
joins are tables in the shared folder: lineage stays short, and large groups
(the links of one centre, the nodes of one label) are split by adaptive
execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label (the component's smallest node) of every node in links (a, b); the table is written."""
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("label")), "labels")
    while True:
        near = edges.join(labels, F.col("u") == F.col("node")).select(F.col("v").alias("node"), "label")
        least = near.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        jumped = written(least.join(up, F.col("label") == F.col("n2")).select("node", F.col("l2").alias("label")), "labels")
        old = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        changed = jumped.join(old, (F.col("node") == F.col("n2")) & (F.col("label") == F.col("l2")), "left_anti")
        over = changed.isEmpty()
        drop(labels)
        labels = jumped
        if over:
            drop(edges)
            return labels
