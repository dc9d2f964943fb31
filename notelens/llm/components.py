"""Connected components of links, by least labels and pointer jumping; labels and links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.sources.tables import staged


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) for each node of the links (a, b).

    Every pass takes the least label among the neighbours and then the label of that label, so a chain
    of n links needs about log n passes. Each pass is written to the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = staged(spark, both.distinct(), "links")
    labels = staged(spark, edges.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    if labels.isEmpty():
        return labels
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near")).withColumnRenamed("a", "node")
        moved = labels.join(near, "node").select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("beyond"))
        passed = staged(spark, moved.join(jump, "to", "left").select("node", F.least("to", F.coalesce("beyond", "to")).alias("comp"), "was"), "labels")
        if passed.filter("comp <> was").isEmpty():
            return passed.select("node", "comp")
        labels = passed.select("node", "comp")
