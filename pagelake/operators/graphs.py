"""Repeated joins over edges: connected components, and distances by new frontiers only. Every round is written, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.session import written


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component of each node of ``edges`` (a, b)."""
    e = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    e = written(e)
    label = written(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")))
    while True:
        near = e.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        met = label.join(near, "node").select("node", "root", F.least("root", "near").alias("met"))
        # A root may have found a smaller one itself: take over what it found.
        jump = met.select(F.col("node").alias("__n"), F.col("met").alias("__r"))
        met = met.join(jump, F.col("met") == F.col("__n")).select("node", F.least("met", "__r").alias("new"), "root")
        now = written(met.select("node", F.col("new").alias("root"), (F.col("new") != F.col("root")).alias("moved")))
        label = now.select("node", "root")
        if not now.where("moved").limit(1).count():
            return label
