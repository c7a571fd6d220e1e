"""Connected components of a table of links, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of links (a, b).

    Every round takes the smallest label among a node and its neighbours and then follows labels one step,
    so long chains close in a logarithmic number of rounds.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    old = labels
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        better = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        target = better.select(F.col("node").alias("t"), F.col("label").alias("further"))
        jumped = better.join(target, better["label"] == target["t"]).select("node", F.least("label", "further").alias("label"), "old")
        new = materialize(jumped, "labels")
        discard(old)
        if new.where("label <> old").isEmpty():
            discard(edges)
            return new.select("node", "label")
        old, labels = new, new.select("node", "label")
