"""Time bucketing: raw samples to per-session window tables (§ time grids)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..env import durable
from ..functions.signal import finite, spike_clip
from ..functions.timefn import bins, ceil_ts, floor_ts, minutes_between, shift_ts
from .ordered import Ordered
from .quantiles import exact_quantiles

KEY = ["session_id"]


# -- signal strength -----------------------------------------------------
def rssi_window_agg(samples: DataFrame, window_s: int = 300) -> DataFrame:
    """(session, window, beacon) → sum, count, mean. Sums and counts merge, so
    partial aggregation happens before the shuffle."""
    return (
        samples.groupBy("session_id", floor_ts("ts", window_s).alias("w"), "beacon")
        .agg(F.sum("rssi").alias("rssi_sum"), F.count("rssi").alias("rssi_cnt"), F.avg("rssi").alias("rssi_mean"))
    )


def rssi_quality_filter(windows: DataFrame, min_share: float = 0.20) -> DataFrame:
    """Null the mean of thinly sampled (window, beacon) cells.

    Expected samples of a beacon = median of its non-zero counts, at least 1.
    ``coverage`` compares all counts of a window, the thin ones included, with
    the expectation over all beacons of the session.
    """
    windows = durable(windows)  # read three times below; samples are read once
    expected = windows.filter("rssi_cnt > 0").groupBy("session_id", "beacon").agg(
        F.greatest(F.percentile("rssi_cnt", F.lit(0.5)), F.lit(1.0)).alias("expected")
    )
    total = expected.groupBy("session_id").agg(F.sum("expected").alias("total_expected"))
    cover = (
        windows.groupBy("session_id", "w")
        .agg(F.sum("rssi_cnt").alias("_cnt"))
        .join(total, "session_id")
        .select("session_id", "w", F.least(F.col("_cnt") / F.col("total_expected"), F.lit(1.0)).alias("coverage"))
    )
    enough = F.col("rssi_cnt") >= F.greatest(F.ceil(F.col("expected") * min_share), F.lit(1))
    return (
        windows.join(expected, ["session_id", "beacon"])
        .withColumn("rssi_mean", F.when(enough, F.col("rssi_mean")))
        .drop("expected")
        .join(cover, ["session_id", "w"])
    )


def per_time_rssi(samples: DataFrame) -> DataFrame:
    """Mean per (time, beacon): several readings at one instant count once."""
    return samples.groupBy("session_id", "ts", "beacon").agg(F.avg("rssi").alias("rssi"))


def rssi_window_features(samples: DataFrame, windows_s: Sequence[int] = (60, 300, 600, 1800)) -> DataFrame:
    """Mean, median, max, sample variance and count per beacon for several
    window sizes from one scan (sizes become a column)."""
    sizes = F.array(*[F.lit(int(s)) for s in windows_s])
    width = F.col("window_s").cast("bigint") * 1_000_000
    start = F.timestamp_micros(F.floor(F.unix_micros("ts") / width).cast("bigint") * width)
    return (
        per_time_rssi(samples)
        .select("*", F.explode(sizes).alias("window_s"))
        .groupBy("session_id", "window_s", start.alias("w"), "beacon")
        .agg(
            F.avg("rssi").alias("rssi_mean"),
            F.percentile("rssi", F.lit(0.5)).alias("rssi_median"),
            F.max("rssi").alias("rssi_max"),
            F.var_samp("rssi").alias("rssi_var"),
            F.count("rssi").alias("rssi_cnt"),
        )
    )


def beacon_summary(samples: DataFrame) -> DataFrame:
    """Detections, mean, median, min, max and share of time points per beacon.

    The median reads an aggregated table of distinct levels, so a beacon that
    holds a third of all samples is still a small group."""
    levels = samples.groupBy("session_id", "beacon", "rssi").agg(F.count("*").alias("n"))
    times = samples.groupBy("session_id").agg(F.count_distinct("ts").alias("time_points"))
    return (
        levels.groupBy("session_id", "beacon")
        .agg(
            F.sum("n").alias("detections"),
            (F.sum(F.col("rssi") * F.col("n")) / F.sum("n")).alias("mean_rssi"),
            F.percentile("rssi", F.lit(0.5), F.col("n")).alias("median_rssi"),
            F.min("rssi").alias("min_rssi"),
            F.max("rssi").alias("max_rssi"),
        )
        .join(times, "session_id")
        .withColumn("coverage_fraction", F.col("detections") / F.col("time_points"))
        .drop("time_points")
    )


# -- acceleration --------------------------------------------------------
def acc_window_std(samples: DataFrame, window_s: int = 300, min_count: int = 10) -> DataFrame:
    """Sample standard deviation per window over the session's median magnitude;
    NULL below ``min_count`` samples."""
    scale = exact_quantiles(samples, KEY, "magnitude", {"scale": 0.5})
    scale = scale.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1.0)))
    windows = samples.groupBy("session_id", floor_ts("ts", window_s).alias("w")).agg(
        F.stddev_samp("magnitude").alias("_std"), F.count("magnitude").alias("acc_count")
    )
    value = F.coalesce(finite("_std"), F.lit(0.0)) / F.col("scale")
    return windows.join(scale, "session_id").select(
        "session_id",
        "w",
        "acc_count",
        F.when(F.col("acc_count") >= min_count, value).alias("acc_std"),
        (F.col("acc_count") > 0).alias("acc_online"),
    )


def acc_window_stats(samples: DataFrame, window_s: int = 600) -> DataFrame:
    """Count, mean, population std, range and low-variation flag (at or under
    the session's 25th percentile of window stds)."""
    windows = samples.groupBy("session_id", floor_ts("ts", window_s).alias("w")).agg(
        F.count("magnitude").alias("acc_count"),
        F.avg("magnitude").alias("acc_mean"),
        F.stddev_pop("magnitude").alias("acc_std"),
        F.min("magnitude").alias("acc_min"),
        F.max("magnitude").alias("acc_max"),
    )
    cut = F.percentile(F.round("acc_std", 12), F.lit(0.25)).over(Window.partitionBy("session_id"))
    return (
        windows.withColumn("cut", cut)
        .withColumn("acc_range", F.col("acc_max") - F.col("acc_min"))
        .withColumn("low_acc_variation", (F.round("acc_std", 12) <= F.col("cut")).cast("int"))
        .withColumn("has_acc_data", (F.col("acc_count") > 0).cast("int"))
        .drop("cut")
    )


def acc_window_clean(
    samples: DataFrame, window_s: int = 300, spike_limit: float = 1.2, high_std: float = 0.010, mode: str = "replace"
) -> DataFrame:
    """Clean mean/std with spikes handled, raw max, spike count, high-motion flag."""
    spike = F.col("magnitude") > spike_limit
    return (
        samples.groupBy("session_id", floor_ts("ts", window_s).alias("w"))
        .agg(
            F.count("magnitude").alias("acc_count"),
            F.avg(spike_clip("magnitude", spike_limit, mode)).alias("clean_mean"),
            F.stddev_samp(spike_clip("magnitude", spike_limit, mode)).alias("clean_std"),
            F.max("magnitude").alias("raw_max"),
            F.sum(spike.cast("int")).alias("spike_count"),
        )
        .withColumn(
            "high_motion", F.coalesce(F.col("clean_std") >= high_std, F.lit(False)) | (F.col("spike_count") > 0)
        )
    )


# -- steps -----------------------------------------------------------------
def step_increments(samples: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Cumulative counter → non-negative increments; a reset counts 0 and is flagged."""
    df = Ordered(samples, ties=ties).lag(prev_cnt="cnt", prev_ts="ts").done()
    diff = F.col("cnt") - F.col("prev_cnt")
    return df.withColumns(
        {
            "increment": F.when(diff > 0, diff).otherwise(F.lit(0.0)),
            "reset": F.coalesce(diff < 0, F.lit(False)),
        }
    )


def step_window_agg(increments: DataFrame, window_s: int = 600, ties: Sequence[str] = ()) -> DataFrame:
    """Steps per window with empty windows between first and last kept as zero."""
    order = F.struct("ts", *ties)
    agg = increments.groupBy("session_id", floor_ts("ts", window_s).alias("w")).agg(
        F.sum("increment").alias("steps_in_window"),
        F.count("cnt").alias("step_samples"),
        F.sum(F.col("reset").cast("int")).alias("step_resets"),
        F.min_by("cnt", order).alias("step_count_start"),
        F.max_by("cnt", order).alias("step_count_end"),
    )
    agg = durable(agg)  # grid, join and cut all read it
    grid = window_grid(agg, window_s)
    full = grid.join(agg, ["session_id", "w"], "left").na.fill(
        0, ["steps_in_window", "step_samples", "step_resets"]
    )
    cut = agg.filter("steps_in_window > 0").groupBy("session_id").agg(
        F.percentile("steps_in_window", F.lit(0.25)).alias("cut")
    )
    return (
        full.join(cut, "session_id", "left")
        .withColumn("steps_per_minute", F.col("steps_in_window") / (window_s / 60.0))
        .withColumn("low_step_motion", (F.col("steps_in_window") <= F.coalesce("cut", F.lit(0.0))).cast("int"))
        .withColumn("has_step_data", (F.col("step_samples") > 0).cast("int"))
        .drop("cut")
    )


def step_zero_plateau(
    increments: DataFrame, window_s: int = 300, max_gap_s: int = 2100
) -> DataFrame:
    """Observed windows plus windows proven to be zero: an unchanged counter at
    most ``max_gap_s`` apart. Rising counters and longer gaps stay unknown.

    ``increments`` comes from :func:`step_increments`."""
    observed = increments.groupBy("session_id", floor_ts("ts", window_s).alias("w")).agg(
        F.sum("increment").alias("step_increment"), F.count("cnt").alias("samples")
    )
    observed = durable(observed)
    gap = F.unix_micros("ts") - F.unix_micros("prev_ts")
    proven = increments.filter((F.col("cnt") == F.col("prev_cnt")) & (gap > 0) & (gap <= max_gap_s * 1_000_000))
    first = shift_ts(floor_ts("prev_ts", window_s), window_s)
    zero = (
        proven.select("session_id", F.explode(bins(first, F.col("ts"), window_s, closed=True)).alias("w"))
        .distinct()
        .join(observed.select("session_id", "w"), ["session_id", "w"], "left_anti")
        .select("session_id", "w", F.lit(0.0).alias("step_increment"), F.lit(0).cast("bigint").alias("samples"), F.lit(True).alias("reconstructed"))
    )
    return observed.withColumn("reconstructed", F.lit(False)).unionByName(zero).withColumn("step_online", F.lit(True))


def step_adjusted_cumulative(samples: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Unwrap counter resets: at every drop add the value before the drop."""
    o = Ordered(samples, ties=ties).lag(_prev="cnt")
    dropped = F.when(F.col("cnt") < F.col("_prev"), F.col("_prev")).otherwise(F.lit(0.0))
    o = Ordered(o.df.withColumn("_drop", dropped), ties=ties, chunk_seconds=o.chunk_seconds).running_sum(_offset="_drop")
    return o.done().withColumn("adjusted_cnt", F.col("cnt") + F.col("_offset")).drop("_prev", "_drop", "_offset")


def interpolate_at(
    known: DataFrame, targets: DataFrame, value: str, hold_before: bool = False, chunk_seconds: int = 86_400
) -> DataFrame:
    """Linear-in-time value of ``known(session_id, ts, value)`` at each
    ``targets(session_id, ts)``. After the last known point the value is held;
    before the first it is NULL unless ``hold_before``."""
    a = known.filter(F.col(value).isNotNull()).select(
        "session_id", "ts", F.lit(0).alias("_kind"), F.struct(F.col("ts").alias("t"), F.col(value).cast("double").alias("v")).alias("_p")
    )
    b = targets.select("session_id", "ts", F.lit(1).alias("_kind"), F.lit(None).cast("struct<t:timestamp,v:double>").alias("_p"))
    is_known = F.col("_kind") == 0
    both = (
        Ordered(a.unionByName(b), ties=["_kind"], chunk_seconds=chunk_seconds)
        .apply(last_known={"_before": ("_p", is_known)}, next_known={"_after": ("_p", is_known)})
        .done()
    )
    span = F.unix_micros(F.col("_after.t")) - F.unix_micros(F.col("_before.t"))
    part = (F.unix_micros("ts") - F.unix_micros(F.col("_before.t"))) / span
    linear = F.col("_before.v") + (F.col("_after.v") - F.col("_before.v")) * F.when(span == 0, F.lit(0.0)).otherwise(part)
    out = F.when(F.col("_before").isNotNull() & F.col("_after").isNotNull(), linear).otherwise(F.col("_before.v"))
    if hold_before:
        out = F.coalesce(out, F.col("_after.v"))
    return both.filter(F.col("_kind") == 1).select("session_id", "ts", out.alias(value))


def step_uniformise(samples: DataFrame, window_s: int = 600, ties: Sequence[str] = ()) -> DataFrame:
    """Unwrapped counter interpolated at each minute, differenced, re-bucketed."""
    unwrapped = step_adjusted_cumulative(samples, ties)
    # one value per time, read for the span and for the interpolation
    known = durable(unwrapped.groupBy("session_id", "ts").agg(F.max_by("adjusted_cnt", F.struct("ts", *ties)).alias("v")))
    span = known.groupBy("session_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    minutes = span.select(
        "session_id", F.explode(F.sequence(floor_ts("a", 60), ceil_ts("b", 60), F.expr("interval 1 minute"))).alias("ts")
    )
    at_minute = interpolate_at(known, minutes, "v")
    # the minute grid is as long as the recording, not as its samples
    per_minute = at_minute.withColumn("_prev", F.lag("v").over(Window.partitionBy("session_id").orderBy("ts")))
    inc = F.greatest(F.coalesce(F.col("v") - F.col("_prev"), F.lit(0.0)), F.lit(0.0))
    return (
        per_minute.withColumn("steps_in_minute", inc)
        .groupBy("session_id", floor_ts("ts", window_s).alias("w"))
        .agg(F.sum("steps_in_minute").alias("steps_in_window"), F.count("*").alias("step_samples"))
    )


# -- pressure ----------------------------------------------------------------
def pressure_window_mean(samples: DataFrame, window_s: int = 300) -> DataFrame:
    return samples.groupBy("session_id", floor_ts("ts", window_s).alias("w")).agg(
        F.avg("hpa").alias("pressure"), (F.count("hpa") > 0).alias("pressure_online")
    )


# -- grids -----------------------------------------------------------------
def window_grid(windows: DataFrame, window_s: int, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Every window between the first and last one present, per key."""
    step = F.expr(f"make_dt_interval(0, 0, 0, {int(window_s)})")
    return (
        windows.groupBy(*keys)
        .agg(F.min("w").alias("_a"), F.max("w").alias("_b"))
        .select(*keys, F.explode(F.sequence("_a", "_b", step)).alias("w"))
    )


def grid_session(tables: Sequence[DataFrame], window_s: int = 300) -> DataFrame:
    """Common grid over all sensors of a session, end inclusive. Each table has
    (session_id, w); only one row per table and session reaches the union."""
    spans = None
    for t in tables:
        s = t.groupBy("session_id").agg(F.min("w").alias("a"), F.max("w").alias("b"))
        spans = s if spans is None else spans.unionByName(s)
    step = F.expr(f"make_dt_interval(0, 0, 0, {int(window_s)})")
    return (
        spans.groupBy("session_id")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"))
        .select("session_id", F.explode(F.sequence("a", "b", step)).alias("w"))
    )


def grid_common(windows: DataFrame, pairs: DataFrame, window_s: int) -> DataFrame:
    """Windows shared by both sessions of a pair: latest start to earliest end."""
    span = windows.groupBy("session_id").agg(F.min("w").alias("a"), F.max("w").alias("b"))
    left = span.select(F.col("session_id").alias("left_session"), F.col("a").alias("la"), F.col("b").alias("lb"))
    right = span.select(F.col("session_id").alias("right_session"), F.col("a").alias("ra"), F.col("b").alias("rb"))
    step = F.expr(f"make_dt_interval(0, 0, 0, {int(window_s)})")
    return (
        pairs.join(left, "left_session")
        .join(right, "right_session")
        .withColumn("a", F.greatest("la", "ra"))
        .withColumn("b", F.least("lb", "rb"))
        .filter("a <= b")
        .select("pair_id", "left_session", "right_session", F.explode(F.sequence("a", "b", step)).alias("w"))
    )


def online_any(grid: DataFrame, tables: Sequence[DataFrame]) -> DataFrame:
    """Wearable online where any sensor table has a row in the window."""
    seen = None
    for t in tables:
        s = t.select("session_id", "w")
        seen = s if seen is None else seen.unionByName(s)
    seen = seen.distinct().withColumn("_on", F.lit(True))
    return grid.join(seen, ["session_id", "w"], "left").withColumn(
        "wearable_online", F.coalesce("_on", F.lit(False))
    ).drop("_on")


def movement_source(windows: DataFrame, acc: str = "acc_std", step: str = "step_increment") -> DataFrame:
    """Acceleration when the session has any value of it, else steps, else unresolved."""
    has = windows.groupBy("session_id").agg(
        F.bool_or(F.col(acc).isNotNull()).alias("_a"), F.bool_or(F.col(step).isNotNull()).alias("_s")
    )
    source = F.when(F.col("_a"), "acc").when(F.col("_s"), "step").otherwise("unresolved")
    return (
        windows.join(has, "session_id")
        .withColumn("movement_source", source)
        .withColumn(
            "movement_value",
            F.when(F.col("movement_source") == "acc", F.col(acc)).when(F.col("movement_source") == "step", F.col(step)),
        )
        .drop("_a", "_s")
    )


def align_floor(anchors: DataFrame, sized: DataFrame, sizes_s: Sequence[int], values: Sequence[str]) -> DataFrame:
    """For each anchor (session_id, w) the row of the enclosing window of every
    size; columns become ``<value>_<minutes>m``.

    ``sized(session_id, window_s, w, values…)`` holds all sizes, so the join is
    one equi-join on an exploded key and one conditional aggregation."""
    size = F.array(*[F.lit(int(s)) for s in sizes_s])
    width = F.col("window_s").cast("bigint") * 1_000_000
    start = F.timestamp_micros(F.floor(F.unix_micros("anchor") / width).cast("bigint") * width)
    wide_anchor = anchors.select("session_id", F.col("w").alias("anchor"), F.explode(size).alias("window_s")).withColumn("w", start)
    picked = sized.select("session_id", F.col("window_s").cast("int"), "w", F.struct(*values).alias("_row"))
    joined = wide_anchor.join(picked, ["session_id", "window_s", "w"], "left")
    cols = [
        F.max(F.when(F.col("window_s") == s, F.col(f"_row.{v}"))).alias(f"{v}_{s // 60}m")
        for s in sizes_s
        for v in values
    ]
    return joined.groupBy("session_id", F.col("anchor").alias("w")).agg(*cols)


def features_outer(rssi: DataFrame, steps: DataFrame, acc: DataFrame) -> DataFrame:
    """Full outer join on (session, window); step fields become 0 where absent."""
    keys = ["session_id", "w"]
    step_cols = [c for c in steps.columns if c not in keys]
    return rssi.join(steps, keys, "full_outer").join(acc, keys, "full_outer").na.fill(0, step_cols)


# -- availability ------------------------------------------------------------
def availability_gaps(
    observed: DataFrame, window_s: int, min_gap_s: int = 3600, confirmed: DataFrame | None = None
) -> DataFrame:
    """Missing runs of at least ``min_gap_s`` between observed windows.

    A gap is what lies between two consecutive observed windows, so no grid is
    needed. ``confirmed(session_id, gap_id, start, end)`` matches on the exact
    first and last missing window."""
    order = Window.partitionBy("session_id").orderBy("w")
    seen = observed.select("session_id", "w").distinct()
    gaps = (
        seen.withColumn("next_observed", F.lead("w").over(order))
        .withColumn("missing_windows", ((F.unix_micros("next_observed") - F.unix_micros("w")) / (window_s * 1_000_000) - 1).cast("bigint"))
        .filter((F.col("missing_windows") * window_s >= min_gap_s) & (F.col("missing_windows") > 0))
        .select(
            "session_id",
            shift_ts("w", window_s).alias("gap_start"),
            shift_ts("next_observed", -window_s).alias("gap_end"),
            "missing_windows",
            (F.col("missing_windows") * (window_s / 60.0)).alias("missing_minutes"),
            F.col("w").alias("previous_observed"),
            "next_observed",
        )
    )
    numbered = gaps.withColumn(
        "_nr", F.row_number().over(Window.partitionBy("session_id").orderBy("gap_start"))
    )
    auto = F.concat(F.lit("long_environmental_gap_"), F.col("_nr"))
    if confirmed is None:
        return numbered.withColumns({"gap_id": auto, "confirmed_out_of_home": F.lit(False)}).drop("_nr")
    c = confirmed.select("session_id", F.col("start").alias("gap_start"), F.col("end").alias("gap_end"), F.col("gap_id").alias("_cid"))
    return (
        numbered.join(c, ["session_id", "gap_start", "gap_end"], "left")
        .withColumn("gap_id", F.coalesce("_cid", auto))
        .withColumn("confirmed_out_of_home", F.col("_cid").isNotNull())
        .drop("_nr", "_cid")
    )


def environmental_availability(observed: DataFrame, window_s: int, gaps: DataFrame) -> DataFrame:
    """Full grid with observed / long-gap / confirmed flags."""
    seen = observed.select("session_id", "w").distinct()
    grid = window_grid(seen, window_s)
    inside = gaps.select(
        "session_id",
        F.explode(bins("gap_start", "gap_end", window_s, closed=True)).alias("w"),
        F.lit(True).alias("long_gap"),
        "confirmed_out_of_home",
    )
    return (
        grid.join(seen.withColumn("available", F.lit(True)), ["session_id", "w"], "left")
        .join(inside, ["session_id", "w"], "left")
        .na.fill(False, ["available", "long_gap", "confirmed_out_of_home"])
    )


def availability_summary(samples: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Rows, span, median sampling interval, expected rows, coverage per session
    and sensor of ``samples(session_id, sensor, ts, …)``."""
    keys = ["session_id", "sensor"]
    lagged = Ordered(samples, keys=keys, ties=ties).lag(_prev="ts").done()
    gaps = lagged.withColumn("_gap", minutes_between("_prev", "ts"))
    med = exact_quantiles(gaps, keys, "_gap", {"median_interval_minutes": 0.5})
    span = samples.groupBy(*keys).agg(F.count("*").alias("rows"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    minutes = minutes_between("start_time", "end_time")
    expected = F.when(
        F.col("median_interval_minutes") > 0, F.floor(minutes / F.col("median_interval_minutes")) + 1
    )
    return (
        span.join(med, keys, "left")
        .withColumn("duration_hours", minutes / 60)
        .withColumn("expected_rows", expected)
        .withColumn("coverage_fraction", F.col("rows") / F.col("expected_rows"))
    )


def availability_overlap(samples: DataFrame) -> DataFrame:
    """Span and rate per (side, sensor) of ``samples(side, sensor, ts)`` plus the
    overlap shared by all sides."""
    per = samples.groupBy("side", "sensor").agg(
        F.count("*").alias("rows"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time")
    )
    per = per.withColumn("duration_hours", minutes_between("start_time", "end_time") / 60)
    # one row per (side, sensor) from here on: the dimension, not the samples
    side = per.groupBy("side").agg(F.max("start_time").alias("s"), F.min("end_time").alias("e"))
    common = side.agg(F.max("s").alias("common_overlap_start"), F.min("e").alias("common_overlap_end"))
    hours = F.greatest(minutes_between("common_overlap_start", "common_overlap_end") / 60, F.lit(0.0))
    return (
        per.withColumn("_one", F.lit(1))
        .join(F.broadcast(common.withColumn("_one", F.lit(1))), "_one")
        .drop("_one")
        .withColumn("rows_per_hour", F.when(F.col("duration_hours") > 0, F.col("rows") / F.col("duration_hours")))
        .withColumn("common_overlap_hours", hours)
        .withColumn(
            "common_overlap_fraction",
            F.when(
                F.col("duration_hours") > 0,
                F.least(F.greatest(F.col("common_overlap_hours") / F.col("duration_hours"), F.lit(0.0)), F.lit(1.0)),
            ),
        )
    )
