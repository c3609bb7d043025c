"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenceline.sources.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node that links reach.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so a
    chain shortens by more than half; every round is stored. Only a count reaches the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = materialize(both.distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        up = own.select(F.col("node").alias("up"), F.col("label").alias("further"))
        new = own.join(up, own["label"] == up["up"], "left").select(
            "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")
        )
        new = materialize(new, "labels")
        labels = new.select("node", "label")
        if new.where("label < old").limit(1).count() == 0:
            return labels
