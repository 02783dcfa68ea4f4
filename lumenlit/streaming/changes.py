"""Streaming operators: change streams, stage state, event-time windows."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenlit.operators.shared import shared_folder


def newer_only(stream: DataFrame, key: str, stamp: str) -> DataFrame:
    """Rows of a key with a stamp above all stamps seen before, in stamp order.

    The state of a key is its highest stamp. Repeated and older rows give
    nothing; a dropDuplicates on the key would lose changed rows.
    """

    def step(k, batches, state: GroupState):
        seen = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("stamp", kind="stable")
        out = []
        for s in rows["stamp"]:
            if seen is None or s > seen:
                out.append(s)
                seen = s
        if seen is not None:
            state.update((seen,))
        yield pd.DataFrame({"key": [k[0]] * len(out), "stamp": out})

    flat = stream.select(F.col(key).cast("string").alias("key"), F.col(stamp).cast("long").alias("stamp"))
    return flat.groupBy("key").applyInPandasWithState(step, "key string, stamp long", "seen long", "append", GroupStateTimeout.NoTimeout)


def stage_state(stream: DataFrame, key: str, ok: str, most: int = 3) -> DataFrame:
    """Upserted stage of each key: attempts so far and done, retry or failed."""

    def step(k, batches, state: GroupState):
        attempts, done = state.get if state.exists else (0, False)
        for b in batches:
            for good in b["ok"]:
                if not done:
                    attempts += 1
                    done = bool(good)
        state.update((attempts, done))
        yield pd.DataFrame({"key": [k[0]], "attempts": [attempts], "stage": ["done" if done else "failed" if attempts >= most else "retry"]})

    flat = stream.select(F.col(key).cast("string").alias("key"), F.col(ok).alias("ok"))
    return flat.groupBy("key").applyInPandasWithState(step, "key string, attempts int, stage string", "attempts int, done boolean", "update", GroupStateTimeout.NoTimeout)


def tumbling(stream: DataFrame, stamp: str, value: str, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    w = stream.withWatermark(stamp, delay).groupBy(F.window(stamp, length).alias("w"))
    return w.agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def sliding(stream: DataFrame, stamp: str, length: str = "1 hour", step: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    w = stream.withWatermark(stamp, delay).groupBy(F.window(stamp, length, step).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, key: str, stamp: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    w = stream.withWatermark(stamp, delay).groupBy(key, F.session_window(stamp, gap).alias("w"))
    return w.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drained(spark: SparkSession, result: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Run a stream over all that is there and return what it gave.

    Append results are written as files; updates are merged batch by batch, the
    last one of each key standing.
    """
    base = folder or shared_folder(spark)
    base = f"{base}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = result.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(result.schema).parquet(f"{base}/out")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/out/batch={epoch}")

    result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out/*")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table read as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf_dir}/{name}.parque[t]")


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
