"""Strongest beacon, modal label and other top-k questions, without pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import floor_ts

UNKNOWN = "Unknown"


def top_two(rows: DataFrame, keys: Sequence[str], item: str, value: str, descending: bool = True) -> DataFrame:
    """Best and second-best ``item`` by ``value`` per ``keys``; equal values go
    to the smaller item.

    Spark turns ``row_number <= 2`` into a group limit in each map task, so at
    most two rows per key and task reach the shuffle, however large a group is."""
    sign = F.col(value) if descending else -F.col(value)
    known = rows.filter(F.col(value).isNotNull()).withColumn("_s", sign)
    order = Window.partitionBy(*keys).orderBy(F.col("_s").desc(), F.col(item).asc())
    ranked = known.withColumn("_r", F.row_number().over(order)).filter("_r <= 2")
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.col(item))).alias("best_item"),
        F.max(F.when(F.col("_r") == 1, F.col(value))).alias("best_value"),
        F.max(F.when(F.col("_r") == 2, F.col(item))).alias("second_item"),
        F.max(F.when(F.col("_r") == 2, F.col(value))).alias("second_value"),
    )


def strongest_beacon(windows: DataFrame, beacons: DataFrame | None = None, keys: Sequence[str] = ("session_id", "w")) -> DataFrame:
    """Strongest and second beacon, gap in dB, samples, beacons present, room.

    ``windows(session_id, w, beacon, rssi_mean, rssi_cnt)``; windows whose means
    are all NULL keep a row with ``rssi_observed = false``.
    ``beacons(session_id?, beacon, room)``."""
    keys = list(keys)
    # ranking and totals share one shuffle by (session, window); a group has one
    # row per beacon heard in the window
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("rssi_mean"), F.asc("beacon"))
    rank = F.when(F.col("rssi_mean").isNotNull(), F.row_number().over(order))
    out = (
        windows.withColumn("_r", rank)
        .groupBy(*keys)
        .agg(
            F.sum("rssi_cnt").alias("rssi_sample_count"),
            F.count("rssi_mean").alias("rssi_available_beacons"),
            F.max(F.when(F.col("_r") == 1, F.col("beacon"))).alias("strongest_beacon"),
            F.max(F.when(F.col("_r") == 1, F.col("rssi_mean"))).alias("strongest_rssi"),
            F.max(F.when(F.col("_r") == 2, F.col("rssi_mean"))).alias("second_rssi"),
        )
        .withColumn("rssi_observed", F.col("rssi_available_beacons") > 0)
        .withColumn("gap_db", F.col("strongest_rssi") - F.col("second_rssi"))
    )
    if beacons is None:
        return out
    return attach_room(out, beacons, "strongest_beacon", "room")


def attach_room(df: DataFrame, beacons: DataFrame, beacon: str, room: str) -> DataFrame:
    """Room of a beacon; ``Unknown`` where unmapped, NULL where there is no beacon."""
    on = [c for c in ("session_id",) if c in beacons.columns]
    lookup = beacons.select(*on, F.col("beacon").alias(beacon), F.col("room").alias("_room"))
    return (
        df.join(lookup, [*on, beacon], "left")
        .withColumn(room, F.when(F.col(beacon).isNotNull(), F.coalesce("_room", F.lit(UNKNOWN))))
        .drop("_room")
    )


def strongest_share(samples: DataFrame, window_s: int, descending: bool = True) -> DataFrame:
    """Winner beacon at each sample time, then each beacon's share of the
    window's winners, and the window's dominance (largest share)."""
    at_time = samples.groupBy("session_id", "ts", "beacon").agg(F.avg("rssi").alias("rssi"))
    sign = F.col("rssi") if descending else -F.col("rssi")
    best = F.min_by("beacon", F.struct((-sign).alias("a"), F.col("beacon").alias("b")))
    winner = at_time.groupBy("session_id", "ts").agg(best.alias("beacon"))
    counts = winner.groupBy("session_id", floor_ts("ts", window_s).alias("w"), "beacon").agg(F.count("*").alias("wins"))
    window = Window.partitionBy("session_id", "w")
    return counts.withColumn("share", F.col("wins") / F.sum("wins").over(window)).withColumn(
        "dominance", F.max("share").over(window)
    )


def mode_label(rows: DataFrame, keys: Sequence[str], label: str, weight: str | None = None) -> DataFrame:
    """Most frequent non-null label per ``keys``; ties go to the smallest label.

    Counts are merged first, so the ranking sees one row per (keys, label)."""
    n = F.sum(weight) if weight else F.count("*")
    counts = rows.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(n.alias("n"))
    return (
        counts.groupBy(*keys)
        .agg(
            F.min_by(F.struct(label, "n"), F.struct((-F.col("n")).alias("a"), F.col(label).alias("b"))).alias("_best"),
            F.sum("n").alias("total"),
        )
        .select(*keys, F.col(f"_best.{label}").alias(label), F.col("_best.n").alias("n"), "total")
    )


def nearest_pressure_beacon(wearable: DataFrame, environment: DataFrame, window_s: int) -> DataFrame:
    """Beacon whose window-median pressure is nearest to the wearable's.

    ``wearable(session_id, ts, hpa)``, ``environment(session_id, ts, sensor, hpa)``."""
    diff = pressure_differences(wearable, environment, window_s)
    top = top_two(diff, ["session_id", "w", "wearable_hpa"], "sensor", "abs_diff", descending=False)
    return top.select(
        "session_id",
        "w",
        "wearable_hpa",
        F.col("best_item").alias("closest_beacon"),
        F.col("best_value").alias("closest_abs_diff"),
        F.col("second_value").alias("second_abs_diff"),
        (F.col("second_value") - F.col("best_value")).alias("closest_margin"),
    )


def pressure_differences(wearable: DataFrame, environment: DataFrame, window_s: int) -> DataFrame:
    """Wearable minus beacon, medians per window, long form."""
    env = environment.groupBy("session_id", floor_ts("ts", window_s).alias("w"), "sensor").agg(
        F.percentile("hpa", F.lit(0.5)).alias("beacon_hpa")
    )
    wear = wearable.groupBy("session_id", floor_ts("ts", window_s).alias("w")).agg(
        F.percentile("hpa", F.lit(0.5)).alias("wearable_hpa")
    )
    return (
        wear.join(env, ["session_id", "w"])
        .withColumn("diff", F.col("wearable_hpa") - F.col("beacon_hpa"))
        .withColumn("abs_diff", F.abs("diff"))
    )


def weakest_beacon_diagnostic(samples: DataFrame, window_s: int) -> DataFrame:
    """Strongest and weakest beacon by window mean and by share of sample-time
    winners, as a check on the sign of the signal scale."""
    from .windows import rssi_window_agg

    keys = ["session_id", "w"]
    means = rssi_window_agg(samples, window_s)
    by_mean = means.groupBy(*keys).agg(
        F.min_by("beacon", F.struct((-F.col("rssi_mean")).alias("a"), F.col("beacon").alias("b"))).alias("max_beacon"),
        F.min_by("beacon", F.struct(F.col("rssi_mean").alias("a"), F.col("beacon").alias("b"))).alias("min_beacon"),
    )

    def by_share(name: str, descending: bool) -> DataFrame:
        share = strongest_share(samples, window_s, descending)
        return share.groupBy(*keys).agg(
            F.min_by("beacon", F.struct((-F.col("wins")).alias("a"), F.col("beacon").alias("b"))).alias(f"prop_{name}_beacon"),
            F.max("share").alias(f"prop_{name}_fraction"),
        )

    return by_mean.join(by_share("max", True), keys).join(by_share("min", False), keys)


def interval_mode(intervals: DataFrame, windows: DataFrame, window_s: int, default: str = "Out") -> DataFrame:
    """Room with the most samples among windows starting in ``[start, end)`` and
    the gap of that room's best-sampled window; ``default`` without any window.

    Intervals explode to the window starts they hold, then an equi-join."""
    from ..functions.timefn import bins, ceil_ts

    key = ["session_id", "event_id"]
    hit = (
        intervals.select(*key, F.explode(bins(ceil_ts("start", window_s), F.col("end"), window_s)).alias("w"))
        .join(windows.filter("room is not null").select("session_id", "w", "room", "rssi_sample_count", "gap_db"), ["session_id", "w"])
        .groupBy(*key, "room")
        .agg(
            F.sum("rssi_sample_count").alias("c"),
            F.max_by("gap_db", F.struct("rssi_sample_count", -F.unix_micros("w"))).alias("g"),
        )
        .groupBy(*key)
        .agg(
            F.min_by(F.struct("room", "g"), F.struct((-F.col("c")).alias("a"), F.col("room").alias("b"))).alias("_best"),
            F.sum("c").alias("samples"),
        )
        .select(*key, F.col("_best.room").alias("room"), "samples", F.col("_best.g").alias("best_gap"))
    )
    return intervals.select(*key).join(hit, key, "left").na.fill({"room": default, "samples": 0})
