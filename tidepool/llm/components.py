"""Connected components of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links`` (a, b: long); a component is its least node.

    Every round takes the least label around each node and then the label of
    that label, so the rounds needed grow with the logarithm of the longest
    path. Labels are pre-aggregated before they are dealt out, so a node with
    very many links costs each task one row; state is cut in the shared
    checkpoint folder after each round.
    """
    # both ways from one pass: a union would work the links out twice
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way")
    both = cut(links.where("a <> b").select(ways).select("way.a", "way.b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        nearer = labels.join(around, "node").select("node", F.col("component").alias("before"), F.least("component", "seen").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = cut(nearer.join(jump, "component", "left").select("node", "before", F.least("component", F.coalesce("further", "component")).alias("component")))
        labels = after.select("node", "component")
        if after.where("component <> before").isEmpty():
            return labels
