"""Stair events from floor shifts, with ramp-refined durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signal import SPIKE_LIMIT, spike_clip
from ..functions.timefn import bins, floor_ts, minutes_between, shift_ts

EVENT = ["session_id", "shift_time"]


def direction():
    up = (F.col("previous_floor") == "1F") & (F.col("current_floor") == "2F")
    down = (F.col("previous_floor") == "2F") & (F.col("current_floor") == "1F")
    return F.when(up, "ascent").when(down, "descent").otherwise("unknown")


def stair_events(shifts: DataFrame, acc: DataFrame, window_s: int, reach_s: int = 300, too_long_min: float = 20, window_too_long_min: float = 15) -> DataFrame:
    """Direction, start and end from high-motion windows within ±reach of the
    shift, duration, anomaly flags and texts.

    ``acc(session_id, w, high_motion, spike_count)``."""
    e = shifts.withColumns(
        {
            "stair_direction": direction(),
            "lo": F.greatest("support_start", shift_ts("shift_time", -reach_s)), "hi": F.least(F.col("support_end"), shift_ts("shift_time", reach_s)),
        }
    )
    near = e.select(*EVENT, "lo", "hi", F.explode(bins("lo", "hi", window_s, closed=True)).alias("w")).filter("w >= lo").join(acc, ["session_id", "w"])
    high = F.coalesce(F.col("high_motion"), F.lit(False)) | (F.coalesce("spike_count", F.lit(0)) > 0)
    agg = near.groupBy(*EVENT).agg(
        F.min(F.when(high, F.col("w"))).alias("_a"), F.max(F.when(high, F.col("w"))).alias("_b"), F.count(F.when(high, 1)).alias("high_windows"), F.count("*").alias("support_windows")
    )
    e = e.join(agg, EVENT, "left").na.fill(0, ["high_windows", "support_windows"])
    none = F.col("_a").isNull()
    e = e.withColumns(
        {
            "event_start": F.when(none, shift_ts("shift_time", -window_s)).otherwise(F.col("_a")),
            "event_end": F.when(none, F.col("shift_time")).otherwise(shift_ts("_b", window_s)),
            "method": F.when(none, "floor_shift_window_no_acc_support").otherwise("contiguous_high_acc_windows_near_shift"),
            "label": F.when(F.col("stair_direction") == "ascent", "1F to 2F").when(F.col("stair_direction") == "descent", "2F to 1F"),
            "support_window_min": minutes_between("support_start", "support_end"),
        }
    )
    e = e.withColumn("duration_min", F.greatest(minutes_between("event_start", "event_end"), F.lit(window_s / 60.0)))
    e = e.withColumns({"duration_too_long": F.col("duration_min") > too_long_min, "window_too_long": F.col("support_window_min") > window_too_long_min})
    e = e.withColumn("any_anomaly", F.col("duration_too_long") | F.col("window_too_long"))
    return e.withColumns(
        {
            "anomaly_text": F.when(F.col("duration_too_long"), "duration anomaly: longer than a plausible stair event")
            .when(F.col("window_too_long"), "support window longer than expected; duration clipped to the local window").otherwise("no long-duration anomaly"),
            "support_text": F.when(F.col("supported") & F.col("window_too_long"), "ACC-supported with an unusually long support window")
            .when(F.col("supported"), "ACC-supported").otherwise("ACC-unsupported"),
        }
    ).drop("_a", "_b", "lo", "hi")


def stair_daily(events: DataFrame, observed: DataFrame, window_s: int, zone: str = "UTC") -> DataFrame:
    """Per local date: counts, durations, observed hours and events per hour; all
    observed dates are kept. ``observed(session_id, w)`` = windows with a floor."""
    day = lambda c: F.to_date(F.from_utc_timestamp(c, zone))
    hours = observed.groupBy("session_id", day(F.col("w")).alias("day")).agg((F.count("*") * (window_s / 3600.0)).alias("observed_hours"))
    up, down = F.col("stair_direction") == "ascent", F.col("stair_direction") == "descent"
    per = events.groupBy("session_id", day(F.col("shift_time")).alias("day")).agg(
        F.count("*").alias("stair_events"), F.sum(up.cast("bigint")).alias("ascents"), F.sum(down.cast("bigint")).alias("descents"),
        F.sum(F.col("supported").cast("bigint")).alias("supported_events"), F.sum((~F.col("supported")).cast("bigint")).alias("unsupported_events"),
        F.avg(F.when(up, F.col("duration_min"))).alias("mean_ascent_min"), F.avg(F.when(down, F.col("duration_min"))).alias("mean_descent_min"),
        F.percentile("duration_min", F.lit(0.5)).alias("median_min"),
    )
    out = hours.join(per, ["session_id", "day"], "left").na.fill(0, ["stair_events", "ascents", "descents", "supported_events", "unsupported_events"])
    return out.withColumn("events_per_hour", F.when(F.col("observed_hours") > 0, F.col("stair_events") / F.col("observed_hours")))


def _near(events: DataFrame, samples: DataFrame, lo, hi, bin_s: int, columns: list[str]) -> DataFrame:
    """Samples with lo <= ts <= hi of each event, through shared time bins."""
    e = events.select(*EVENT, *columns, lo.alias("_lo"), hi.alias("_hi")).filter("_lo <= _hi")
    e = e.withColumn("_bin", F.explode(bins("_lo", "_hi", bin_s, closed=True)))
    s = samples.withColumn("_bin", floor_ts("ts", bin_s))
    return e.join(s, ["session_id", "_bin"]).filter((F.col("ts") >= F.col("_lo")) & (F.col("ts") <= F.col("_hi"))).drop("_bin", "_lo", "_hi")


def ramp_progress(
    events: DataFrame, pressure: DataFrame, value: str = "relative_smooth", local_s: int = 300, level_s: int = 120, start: float = 0.10, end: float = 0.90,
    min_delta: float = 0.12, ties: tuple[str, ...] = (),
) -> DataFrame:
    """Pressure levels before and after a shift and the times the running maximum
    of normalised progress first reaches 10 % and 90 %."""
    seg = _near(events, pressure.select("session_id", "ts", *ties, F.col(value).alias("v")), shift_ts("shift_time", -local_s), shift_ts("shift_time", local_s), local_s, ["stair_direction"])
    known = seg.filter("v is not null")
    s = F.col("shift_time")
    order = Window.partitionBy(*EVENT).orderBy("ts", *ties)
    back = Window.partitionBy(*EVENT).orderBy(F.desc("ts"), *[F.desc(t) for t in ties])
    known = known.withColumns({"_i": F.row_number().over(order), "_j": F.row_number().over(back)})
    before = F.col("ts") <= shift_ts(s, -level_s)
    after = F.col("ts") >= shift_ts(s, level_s)
    lv = known.groupBy(*EVENT).agg(
        F.percentile(F.when(before, F.col("v")), F.lit(0.5)).alias("_b"), F.percentile(F.when(F.col("_i") <= 4, F.col("v")), F.lit(0.5)).alias("_b4"),
        F.percentile(F.when(after, F.col("v")), F.lit(0.5)).alias("_a"), F.percentile(F.when(F.col("_j") <= 4, F.col("v")), F.lit(0.5)).alias("_a4"),
    ).select(*EVENT, F.coalesce("_b", "_b4").alias("before_level"), F.coalesce("_a", "_a4").alias("after_level"))
    lv = lv.withColumn("delta", F.round(F.col("after_level") - F.col("before_level"), 9))
    small_delta = F.col("delta").isNull() | (F.abs("delta") < min_delta)
    prog = known.join(lv.filter(~small_delta), EVENT).withColumn("_p", F.round((F.col("v") - F.col("before_level")) / F.col("delta"), 9))
    run = F.max("_p").over(order.rowsBetween(Window.unboundedPreceding, 0))
    prog = prog.withColumn("_m", run).groupBy(*EVENT).agg(
        F.min(F.when(F.col("_m") >= start, F.col("ts"))).alias("ramp_start"), F.min(F.when(F.col("_m") >= end, F.col("ts"))).alias("ramp_end")
    )
    out = events.select(*EVENT, "stair_direction").join(lv, EVENT, "left").join(prog, EVENT, "left")
    crossed = F.col("ramp_start").isNotNull() & F.col("ramp_end").isNotNull()
    sign = F.when(F.col("stair_direction") == "ascent", -1).when(F.col("stair_direction") == "descent", 1).otherwise(0)
    seen = F.col("before_level").isNotNull() | F.col("after_level").isNotNull()
    method = (
        F.when(~seen, "no_pressure_samples_in_local_window").when(small_delta, "pressure_delta_too_small_for_refined_duration")
        .when(crossed, "pressure_10_to_90_percent_ramp").otherwise("pressure_ramp_thresholds_not_crossed")
    )
    return out.withColumns(
        {
            "method": method, "delta_too_small": small_delta, "sign_matches": F.coalesce(F.col("delta") * sign > 0, F.lit(False)),
            "ramp_start": F.when(crossed, F.col("ramp_start")), "ramp_end": F.when(crossed, F.col("ramp_end")),
        }
    ).withColumn("ramp_minutes", minutes_between("ramp_start", "ramp_end"))


def stair_refine(
    ramps: DataFrame, acc: DataFrame, max_minutes: float = 3.0, std_min: float = 0.010, deviation_min: float = 0.030, bin_s: int = 300
) -> DataFrame:
    """Acceleration evidence inside each ramp. ``acc(session_id, ts, magnitude)``."""
    clean = spike_clip("magnitude")
    s = acc.select("session_id", "ts", "magnitude", clean.alias("_c"))
    inside = _near(ramps.filter("ramp_start is not null"), s, F.col("ramp_start"), F.col("ramp_end"), bin_s, [])
    agg = inside.groupBy(*EVENT).agg(
        F.count("*").alias("acc_samples"), F.avg("_c").alias("acc_mean"), F.stddev_samp("_c").alias("acc_std"), F.max("magnitude").alias("acc_max"),
        F.max(F.abs(F.col("_c") - 1.0)).alias("acc_max_deviation"), F.sum((F.col("magnitude") > SPIKE_LIMIT).cast("int")).alias("spike_count"),
    )
    out = ramps.join(agg, EVENT, "left").na.fill(0, ["acc_samples", "spike_count"])
    no = F.lit(False)
    support = F.coalesce(F.col("acc_std") >= std_min, no) | F.coalesce(F.round("acc_max_deviation", 9) >= deviation_min, no) | (F.col("spike_count") > 0)
    reason = (
        F.when(F.col("ramp_start").isNull(), "no_refined_pressure_ramp_interval").when(support, "acc_variability_or_deviation_high_inside_pressure_ramp")
        .otherwise("no_clear_acc_elevation_inside_pressure_ramp")
    )
    return out.withColumns({"acc_supports": support, "acc_reason": reason, "too_long": F.coalesce(F.col("ramp_minutes") > max_minutes, no)})


def stair_refine_summary(refined: DataFrame) -> DataFrame:
    """Durations by direction plus an ``all`` row, by grouping sets."""
    valid = refined.filter("ramp_minutes is not null")
    return (
        valid.groupingSets([["session_id", "stair_direction"], ["session_id"]], "session_id", "stair_direction")
        .agg(
            F.grouping("stair_direction").alias("_g"), F.count("*").alias("events"), F.percentile("ramp_minutes", F.lit(0.5)).alias("median_min"), F.avg("ramp_minutes").alias("mean_min"),
            F.min("ramp_minutes").alias("min_min"), F.max("ramp_minutes").alias("max_min"), F.sum(F.col("acc_supports").cast("bigint")).alias("acc_supported"),
            F.sum(F.col("too_long").cast("bigint")).alias("too_long"),
        )
        .withColumn("stair_direction", F.when(F.col("_g") == 1, "all").otherwise(F.col("stair_direction")))
        .drop("_g")
    )
