"""Streaming windows and stateful step increments.

Input streams have (session_id, ts, …). Each function returns a streaming
DataFrame; the caller picks sink and trigger. Aggregations are bounded by a
watermark, so state does not grow with the stream."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rssi_tumbling(stream: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(window, session, beacon) → sum, count, mean; late rows beyond the delay drop."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", window), "session_id", "beacon")
        .agg(F.sum("rssi").alias("rssi_sum"), F.count("rssi").alias("rssi_cnt"), F.avg("rssi").alias("rssi_mean"))
        .select("session_id", F.col("window.start").alias("w"), "beacon", "rssi_sum", "rssi_cnt", "rssi_mean")
    )


def acc_tumbling(stream: DataFrame, window: str = "5 minutes", delay: str = "10 minutes", min_count: int = 10) -> DataFrame:
    """(window, session) → count and sample deviation (NULL below ``min_count``)."""
    agg = stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "session_id").agg(
        F.count("magnitude").alias("acc_count"), F.stddev_samp("magnitude").alias("_sd")
    )
    return agg.select("session_id", F.col("window.start").alias("w"), "acc_count", F.when(F.col("acc_count") >= min_count, F.col("_sd")).alias("acc_std"))


def low_motion_sessions(stream: DataFrame, window_s: int = 300, interruption_s: int = 900, delay: str = "10 minutes") -> DataFrame:
    """Low-motion windows (session_id, w) bridged into bouts by session windows.
    The gap is one window plus the allowed interruption; windows exactly that far
    apart still join. End = last window plus one window."""
    gap = interruption_s + window_s
    merged = stream.withWatermark("w", delay).groupBy(F.session_window("w", f"{gap} seconds"), "session_id").agg(F.count("*").alias("low_windows"))
    end = F.timestamp_micros(F.unix_micros(F.col("session_window.end")) - (gap - window_s) * 1_000_000)
    return merged.select("session_id", F.col("session_window.start").alias("start"), end.alias("end"), "low_windows")


STEP_OUT = "session_id bigint, ts timestamp, event_id bigint, cnt double, increment double, reset boolean"
STEP_STATE = "cnt double, ms array<bigint>, ties array<bigint>, counts array<double>"


def _step_update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows wait in the state until the watermark has passed them, so that a late row
    takes its place before later ones are compared with it."""
    last, waiting = None, []
    if state.exists:
        last, ms, ties, counts = state.get
        waiting = list(zip(ms, ties, counts))
    for rows in batches:
        micros = rows["ts"].astype("datetime64[us]").astype("int64")
        waiting += list(zip(micros.tolist(), rows["event_id"].tolist(), rows["cnt"].tolist()))
    mark = state.getCurrentWatermarkMs() * 1000
    waiting.sort()
    cut = bisect_left(waiting, (mark,))
    ready, waiting = waiting[:cut], waiting[cut:]
    if ready:
        rows = pd.DataFrame(ready, columns=["ts", "event_id", "cnt"])
        prior = rows["cnt"].shift()
        prior.iloc[0] = float("nan") if last is None else last
        diff = rows["cnt"] - prior
        last = float(rows["cnt"].iloc[-1])
        yield pd.DataFrame({
            "session_id": key[0], "ts": pd.to_datetime(rows["ts"], unit="us"), "event_id": rows["event_id"], "cnt": rows["cnt"],
            "increment": diff.where(diff > 0, 0.0).fillna(0.0), "reset": diff < 0,
        })
    if not waiting and state.hasTimedOut:  # a day of event time without rows: the recording is over
        state.remove()
        return
    state.update((last, *(list(x) for x in zip(*waiting))) if waiting else (last, [], [], []))
    # waiting rows come out when the watermark passes the first of them
    state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1 if waiting else 0, mark // 1000 + 1 if waiting else mark // 1000 + 86_400_000))


def step_increments(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Counter (session_id, ts, event_id, cnt) → non-negative increments in event-time
    order, ``event_id`` breaking ties. A row comes out once the watermark passes it;
    what waits is bounded by ``delay`` and the micro-batch."""
    return (
        stream.select("session_id", "ts", "event_id", "cnt").withWatermark("ts", delay).groupBy("session_id")
        .applyInPandasWithState(_step_update, STEP_OUT, STEP_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
