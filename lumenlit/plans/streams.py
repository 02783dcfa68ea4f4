"""Streaming questions over the events table, drained to the end."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from lumenlit.operators.shared import shared_folder
from lumenlit.plans.registry import query
from lumenlit.streaming import changes as C


def _stream(b):
    return C.stream_table(b.spark, b.dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))  # event time needs a time zone


@query("T01", "", "WITH e AS (SELECT user_id::VARCHAR AS key, (epoch_us(ts) // 1000000)::BIGINT AS stamp FROM events) SELECT DISTINCT key, stamp FROM e")
def change_stream(b):
    """Distinct rising stamps of each user, kept by state."""
    s = _stream(b).select("user_id", F.expr("unix_micros(ts) div 1000000").alias("stamp"))
    return C.drained(b.spark, C.newer_only(s, "user_id", "stamp"), "append")


@query("T03")
def stage_upserts(b):
    """Attempts of each user until the first event above the mean value."""
    s = _stream(b).withColumn("ok", F.col("value") > 120.0)
    out = C.drained(b.spark, C.stage_state(s, "user_id", "ok"), "update")
    last = out.groupBy("key").agg(F.max_by(F.struct("attempts", "stage"), "epoch").alias("s"))
    return last.select("key", "s.attempts", "s.stage")


@query("T10", "", "WITH p AS (SELECT * FROM events WHERE NOT (event_id % 3 = 0 AND ts < TIMESTAMP '2024-01-20')), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM p), w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM p GROUP BY 1) SELECT start, n FROM w, m WHERE start + INTERVAL 1 HOUR <= mark")
def late_dropped(b):
    """Rows that come after their window has closed are dropped: a third of the
    older events come in a third batch, behind the watermark of the first."""
    e = b.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = (F.col("event_id") % 3 == 0) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    folder = f"{shared_folder(b.spark)}/late-{uuid.uuid4().hex}"
    new = F.col("ts") >= F.lit("2024-01-25").cast("timestamp")
    for rows in (e.filter(~late & ~new), e.filter(new), e.filter(late)):  # in this order: a batch each
        rows.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken by their time of change
    stream = b.spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    closed = C.drained(b.spark, C.tumbling(stream, "ts", "value"), "append")
    return closed.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("T10", "", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_batch(b):
    return b.table("events").groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"))


@query("T10", "", "WITH e AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def sessions_batch(b):
    w = F.session_window("ts", "30 minutes").alias("w")
    return b.table("events").groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("T10")
def sessions_stream(b):
    return C.drained(b.spark, C.sessions(_stream(b), "user_id", "ts"), "append").select("user_id", "start", "n")


@query("T10")
def sliding_stream(b):
    return C.drained(b.spark, C.sliding(_stream(b), "ts"), "append")


@query("T05 W02", "", "SELECT event_id, CASE WHEN lag(value) OVER w IS NULL THEN 'unknown' WHEN value > lag(value) OVER w * 1.5 THEN 'changed' ELSE 'same' END AS outcome FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def recheck(b):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    old = F.lag("value").over(w)
    return b.table("events").select("event_id", F.when(old.isNull(), "unknown").when(F.col("value") > old * 1.5, "changed").otherwise("same").alias("outcome"))
