"""Components of graphs that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelens.sources.tables import Scratch


def weak_components(scratch: Scratch, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, comp (the least node of its component) for graphs of edges(keys, a, b), one for each value of the keys.

    Each pass takes the least label among a node's neighbours and then that label's own label, so a chain of n nodes is
    contracted in about log n passes; each pass is written to the shared folder."""
    both = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.staged(both.distinct(), "edges")
    labels = scratch.staged(both.groupBy(*keys, "a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("comp").alias("near")).withColumnRenamed("a", "node")
        moved = labels.join(near, [*keys, "node"]).select(*keys, "node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        jump = labels.select(*keys, F.col("node").alias("to"), F.col("comp").alias("beyond"))
        passed = scratch.staged(moved.join(jump, [*keys, "to"], "left").select(*keys, "node", F.least("to", F.coalesce("beyond", "to")).alias("comp"), "was"), "labels")
        if passed.filter("comp <> was").isEmpty():
            return passed.select(*keys, "node", "comp")
        labels = passed.drop("was")
