"""Streaming operators replayed over the event table as a file stream.

The stream runs to the end of its input in micro-batches and lands in a parquet
table below the shared folder, which the query then reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..env import durable, scratch_path
from ..registry import query
from ..streaming import operators as so
from .ctes import with_ctes
from .ordering import Q, timeline


SLICE_DAYS = 5


def replay(spark, rows, op, time: str = "ts"):
    """Replay ``rows`` as a file stream and read its sink.

    A slice holds five days, in as many files as the rows have partitions, and every
    20th row of its last twelve hours comes late, with the next slice. The stream is run
    to the end of its input after each slice, from where its checkpoint left off, so that
    a slice is one micro-batch, spread over all tasks. A last row far in the future lets
    the watermark pass everything."""
    src, out, ck = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-ck"))
    hours = F.floor(F.unix_micros(time) / 3_600_000_000)
    late = (F.pmod(F.xxhash64(*rows.columns), F.lit(20)) == 0) & (hours % (24 * SLICE_DAYS) >= 24 * SLICE_DAYS - 12)
    sliced = durable(rows.withColumn("_slice", F.floor(hours / (24 * SLICE_DAYS)) + late.cast("int")))
    slices = sorted(r[0] for r in sliced.select("_slice").distinct().collect())
    end = rows.agg(F.max(time).alias("m")).select(*[
        (F.expr("m + interval 400 days") if c == time else F.lit(-1 if c == "session_id" else None)).cast(t).alias(c) for c, t in rows.dtypes
    ])
    for part in [*[sliced.filter(F.col("_slice") == k).drop("_slice") for k in slices], end]:
        part.write.mode("append").parquet(src)
        stream = op(spark.readStream.schema(rows.schema).parquet(src))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).filter("session_id >= 0")


@query("st_rssi_tumbling", "session_id:i w:t beacon:s rssi_sum:f rssi_cnt:i rssi_mean:f", with_ctes("SELECT * FROM rw"))
def _(spark, sf):
    return replay(spark, A.rssi_samples(spark, sf), lambda s: so.rssi_tumbling(s, "1 hour", "1 day"))


@query("st_acc_tumbling", "session_id:i w:t acc_count:i acc_std:f",
       with_ctes("SELECT session_id, time_bucket(INTERVAL 6 HOUR, ts) AS w, count(*) AS acc_count, CASE WHEN count(*) >= 10 THEN stddev_samp(magnitude) END AS acc_std FROM acc GROUP BY 1, 2"))
def _(spark, sf):
    return replay(spark, A.acc_samples(spark, sf), lambda s: so.acc_tumbling(s, "6 hours", "1 day"))


@query("st_step_increments", "session_id:i ts:t event_id:i cnt:f increment:f reset:b",
       with_ctes("""SELECT session_id, ts, event_id, cnt, greatest(coalesce(cnt - p, 0), 0) AS increment, coalesce(cnt < p, false) AS reset
         FROM (SELECT *, lag(cnt) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS p FROM steps)"""))
def _(spark, sf):
    return replay(spark, A.step_samples(spark, sf).select("session_id", "ts", "event_id", "cnt"), lambda s: so.step_increments(s, "1 day"))


@query("st_low_motion_sessions", "session_id:i start:t end:t low_windows:i",
       with_ctes("""SELECT session_id, min(w) AS "start", max(w) + INTERVAL 15 MINUTE AS "end", count(*) AS low_windows FROM (SELECT session_id, w, sum(CASE WHEN p IS NULL OR w - p > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY w) AS g
         FROM (SELECT session_id, w, lag(w) OVER (PARTITION BY session_id ORDER BY w) AS p FROM tl WHERE low_motion)) GROUP BY session_id, g"""))
def _(spark, sf):
    low = timeline(spark, sf).filter("low_motion").select("session_id", "w")
    return replay(spark, low, lambda s: so.low_motion_sessions(s, Q, 900, "1 day"), time="w")
