"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlit.operators.shared import checkpointed


def connected(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of an edge (a, b)
    reaches.

    Every round takes over the smallest label among neighbours and then jumps
    to that label's own label, until a round changes nothing. Labels are written
    after every round, so the plan does not grow.
    """
    both = checkpointed(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct())
    labels = checkpointed(both.select(F.col("x").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = checkpointed(step.join(jump, "component").select("node", F.least("component", "next").alias("component"), "old"))
        labels = new.select("node", "component")
        if not new.filter("component != old").limit(1).count():
            return labels


def degrees(edges: DataFrame) -> DataFrame:
    """node, cites, cited_by."""
    out = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("cites"))
    back = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("cited_by"))
    return out.join(back, "node", "full").select("node", F.coalesce("cites", F.lit(0)).alias("cites"), F.coalesce("cited_by", F.lit(0)).alias("cited_by"))
