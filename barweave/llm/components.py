"""Connected components of an edge table by minimum labels with pointer jumping.

Defined cases: edges with a null end and from a node to itself are left out, repeated edges count once, extra columns are
ignored, no edges give no rows. Nodes may be of any ordered type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); the label is the smallest node of its component.

    Each round takes the least label of the neighbours and then the label of the label, so long chains shorten by
    doubling. A round is written to the shared folder; only the number of changes reaches the driver.
    """
    pairs = edges.where("a <> b").select("a", "b")
    pairs = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        of_neighbour = labels.select(F.col("a").alias("b"), F.col("label").alias("near"))
        near = pairs.join(of_neighbour, "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = labels.join(near, "a").select("a", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("next"))
        step = lower.join(jump, "label").select("a", "old", F.least("label", "next").alias("label"))
        step = stored(step, "labels")
        labels = step.select("a", "label")
        if not step.where("label <> old").count():
            return labels.withColumnRenamed("a", "node")
