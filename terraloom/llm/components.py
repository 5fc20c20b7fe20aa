"""Connected components by smallest label with pointer jumping; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.operators.storage import written


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (node, component) after joining what `links` (a, b) connects.

    Every node of `links` stands in `labels`. Labels are the smallest node of a component. Each
    round lowers labels over all links and then follows each label to its own label; the number of
    rounds grows with the logarithm of a component's diameter.
    """
    first = labels.select(F.col("node").alias("a"), F.col("component").alias("x"))
    second = labels.select(F.col("node").alias("b"), F.col("component").alias("y"))
    between = (
        links.select("a", "b").join(first, "a").join(second, "b").filter("x <> y").select("x", "y")
    )
    edges = written(
        between.union(between.select("y", "x")).distinct().toDF("node", "beside"), "edges"
    )
    if edges.isEmpty():
        return labels
    parent = edges.groupBy("node").agg(F.min("beside").alias("low")).select(
        "node", F.least("node", "low").alias("parent")
    )
    parent = written(parent, "parents")
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = parent.join(up, "parent").select("node", F.col("grand").alias("parent"))
        beside = jumped.select(F.col("node").alias("beside"), F.col("parent").alias("low"))
        lowest = (
            edges.join(beside, "beside").groupBy("node").agg(F.min("low").alias("low"))
        )
        # What a neighbour reaches is also offered to this node's parent, so that trees hang over.
        offers = (
            jumped.join(lowest, "node")
            .select("node", "parent", F.least("parent", "low").alias("low"))
        )
        best = (
            offers.select("node", "low")
            .union(offers.select(F.col("parent").alias("node"), "low"))
            .groupBy("node")
            .agg(F.min("low").alias("parent"))
        )
        new = written(best, "parents")
        changed = new.join(parent.withColumnRenamed("parent", "was"), "node").filter("parent <> was")
        if changed.isEmpty():
            break
        parent = new
    moved = parent.select(F.col("node").alias("component"), F.col("parent").alias("lowest"))
    return written(
        labels.join(moved, "component", "left").select(
            "node", F.coalesce("lowest", "component").alias("component")
        ),
        "labels",
    )
