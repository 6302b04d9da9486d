"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of links(a, b); component is the smallest node reachable.

    Every node takes the smallest label around it and then the label of that label, until nothing
    changes; what is near a small node settles in two rounds, a chain in about its length's logarithm.
    Each round is written to the shared folder, so the plan does not grow.
    """
    links = links.select("a", "b").filter("a <> b")
    edges = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("seen"))
        nearer = labels.join(around, labels["node"] == around["a"]).select("node", "label", F.least("label", "seen").alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = nearer.join(jump, nearer["next"] == jump["at"], "left").select("node", F.least("next", F.coalesce("further", "next")).alias("new"), "label")
        moved = written(moved, "labels")
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.filter("new <> label").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")
