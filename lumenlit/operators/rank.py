"""Ranks over a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlit.operators.shared import checkpointed


def ranked(rows: DataFrame, order: list[Column], running: str | None = None) -> DataFrame:
    """``rows`` with ``rank`` (from 1, in this order, which must be total) and,
    with ``running``, that column's sum up to each row as ``total``. Rows are
    dealt into ranges; only the sizes of ranges, a row for each partition, are
    added up in one place."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = checkpointed(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"), F.sum(running or F.lit(0)).alias("__s"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0"))
    joined = dealt.join(F.broadcast(offsets), "__part")  # a row for each partition
    out = joined.withColumn("rank", (F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.col("__n0")).cast("long"))
    if running:
        own = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("total", F.sum(running).over(own) + F.col("__s0"))
    return out.drop("__part", "__at", "__n0", "__s0")
