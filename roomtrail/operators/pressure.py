"""Pressure cleaning, floor inference and the same-floor signal constraint."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..env import durable
from ..functions.signal import pressure_height
from ..functions.timefn import floor_ts
from .cluster import bootstrap_median_ci, histogram, kmeans1d_ordered, kmedians_trim, label_of, silhouette1d, trim
from .ordered import Ordered
from .runs import rolling_median
from .topk import top_two
from .windows import interpolate_at

# Plausible range and cleaning limits.
MIN_HPA, MAX_HPA = 950.0, 1050.0


@dataclass(frozen=True)
class CleaningParams:
    spike_hpa: float = 1.5
    spike_window: int = 7
    spike_max_rows: int = 2
    plateau_hpa: float = 2.5
    plateau_min_rows: int = 120
    context_rows: int = 60
    residual_hpa: float = 1.2
    residual_max_rows: int = 60


def _positions(df: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """``_rn`` (row position) and ``_all`` (rows of the key)."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return Ordered(one, keys, ties=ties).apply(running_sum={"_rn": "_one"}, total={"_all": "_one"}).done().drop("_one")


def _run_ends(flag: Column) -> tuple[dict, dict]:
    """Positions of the unflagged rows around a run, for ``Ordered.apply``."""
    return {"_pb": ("_rn", ~flag)}, {"_pa": ("_rn", ~flag)}


def _run_span(df: DataFrame) -> DataFrame:
    """``_first`` and ``_len`` of the run a flagged row lies in."""
    first = F.coalesce("_pb", F.lit(0)) + 1
    last = F.coalesce("_pa", F.col("_all") + 1) - 1
    return df.withColumns({"_first": first, "_len": last - first + 1}).drop("_pb", "_pa", "_all")


def interp_runs(df: DataFrame, value: str, anomaly: str, keys: Sequence[str] = ("session_id",), ties: Sequence[str] = (), max_rows: int | None = None) -> DataFrame:
    """Replace runs of anomalous rows (at most ``max_rows`` long) by a row-wise
    line between the nearest good rows; one-sided runs hold that side's value.

    Adds ``_short`` (rows replaced) and ``_long`` (flagged, kept). Two ordered
    passes: positions, then everything a run needs from its surroundings."""
    keys, ties = list(keys), list(ties)
    rows = _positions(df.withColumn("_a", F.coalesce(F.col(anomaly), F.lit(False))), keys, ties)
    good = ~F.col("_a") & F.col(value).isNotNull()
    before, after = _run_ends(F.col("_a"))
    o = Ordered(rows, keys, ties=ties).apply(last_known={"_lo": (value, good), **before}, next_known={"_hi": (value, good), **after})
    out = _run_span(o.done())
    short = F.col("_a") & (F.col("_len") <= max_rows if max_rows is not None else F.lit(True))
    weight = (F.col("_rn") - F.col("_first") + 1) / (F.col("_len") + 1)
    line = F.when(F.col("_lo").isNotNull() & F.col("_hi").isNotNull(), F.col("_lo") + (F.col("_hi") - F.col("_lo")) * weight).otherwise(F.coalesce("_lo", "_hi", value))
    out = out.withColumns({"_short": F.coalesce(short, F.lit(False)), "_long": F.col("_a") & ~F.coalesce(short, F.lit(False))})
    return out.withColumn(value, F.when(F.col("_short"), line).otherwise(F.col(value))).drop("_a", "_first", "_len", "_rn", "_lo", "_hi")


def spike_correct(df: DataFrame, keys: Sequence[str] = ("session_id", "sensor"), ties: Sequence[str] = (), p: CleaningParams | None = None) -> DataFrame:
    """Out-of-range runs, then runs away from the rolling median: short ones are
    interpolated, long ones kept and flagged. Adds ``short_spike``, ``long_spike``
    and ``raw_hpa``."""
    p = p or CleaningParams()
    keys, ties = list(keys), list(ties)
    d = df.withColumn("raw_hpa", F.col("hpa"))
    d = d.withColumn("_range", F.col("hpa").isNotNull() & ~F.col("hpa").between(MIN_HPA, MAX_HPA))
    d = interp_runs(d, "hpa", "_range", keys, ties, p.spike_max_rows).withColumnsRenamed({"_short": "_s1", "_long": "_l1"}).drop("_range")
    d = rolling_median(durable(d), "hpa", "_med", p.spike_window, keys, ties=ties)
    jump = F.col("hpa").isNotNull() & F.col("hpa").between(MIN_HPA, MAX_HPA) & (F.round(F.abs(F.col("hpa") - F.col("_med")), 9) > p.spike_hpa) & ~F.col("_s1") & ~F.col("_l1")
    d = interp_runs(d.withColumn("_jump", jump), "hpa", "_jump", keys, ties, p.spike_max_rows)
    return d.withColumns({"short_spike": F.col("_s1") | F.col("_short"), "long_spike": F.col("_l1") | F.col("_long")}).drop("_s1", "_l1", "_short", "_long", "_jump", "_med")


def beacon_baseline(environment: DataFrame, targets: DataFrame, bin_s: int = 30) -> DataFrame:
    """Median over beacons per time, averaged in bins, interpolated in time at the
    target times; ends are held."""
    per = environment.filter("hpa is not null").groupBy("session_id", "ts").agg(F.percentile("hpa", F.lit(0.5)).alias("hpa"))
    binned = per.groupBy("session_id", floor_ts("ts", bin_s).alias("ts")).agg(F.avg("hpa").alias("baseline"))
    return interpolate_at(binned, targets.select("session_id", "ts").distinct(), "baseline", hold_before=True)


def _blend_runs(df: DataFrame, threshold: float, context_rows: int, min_rows: int | None, max_rows: int | None, ties: list[str]) -> DataFrame:
    """Rows of qualifying offset runs move to baseline plus a line between the
    median normal offsets before and after. ``df`` has hpa, baseline."""
    keys = ["session_id"]
    d = df.withColumn("_off", F.col("hpa") - F.col("baseline"))
    d = d.withColumn("_mask", F.coalesce(F.round(F.abs("_off"), 9) > threshold, F.lit(False)))
    before, after = _run_ends(F.col("_mask"))
    d = Ordered(_positions(d, keys, ties), keys, ties=ties).apply(last_known=before, next_known=after).done()
    d = durable(_run_span(d))
    fits = F.lit(True)
    if min_rows is not None:
        fits = fits & (F.col("_len") >= min_rows)
    if max_rows is not None:
        fits = fits & (F.col("_len") <= max_rows)
    # one row per run: its first row
    runs = d.filter(F.col("_mask") & fits & (F.col("_rn") == F.col("_first"))).select(*keys, "_first", "_len")
    # context rows by position: at most context_rows on each side, exploded
    before = runs.select(*keys, "_first", F.explode(F.sequence(F.col("_first") - context_rows, F.col("_first") - 1)).alias("_rn"), F.lit(True).alias("_b"))
    after = runs.select(*keys, "_first", F.explode(F.sequence(F.col("_first") + F.col("_len"), F.col("_first") + F.col("_len") + context_rows - 1)).alias("_rn"), F.lit(False).alias("_b"))
    normal = d.filter(~F.col("_mask") & F.col("_off").isNotNull()).select(*keys, "_rn", "_off")
    ctx = before.unionByName(after).join(normal, [*keys, "_rn"]).groupBy(*keys, "_first").agg(
        F.percentile(F.when(F.col("_b"), F.col("_off")), F.lit(0.5)).alias("_bo"), F.percentile(F.when(~F.col("_b"), F.col("_off")), F.lit(0.5)).alias("_ao")
    )
    ctx = ctx.select(*keys, "_first", F.lit(True).alias("_mask"), F.coalesce("_bo", "_ao").alias("_bo"), F.coalesce("_ao", "_bo").alias("_ao"))
    out = d.join(ctx, [*keys, "_first", "_mask"], "left")
    done = F.col("_mask") & F.col("_bo").isNotNull()
    weight = (F.col("_rn") - F.col("_first") + 1) / (F.col("_len") + 1)
    fixed = F.col("baseline") + F.col("_bo") + (F.col("_ao") - F.col("_bo")) * weight
    return out.withColumns({"corrected": done, "kept_long": F.col("_mask") & ~fits if max_rows is not None else F.lit(False)}).withColumn(
        "hpa", F.when(F.col("corrected"), fixed).otherwise(F.col("hpa"))
    ).drop("_off", "_mask", "_first", "_len", "_rn", "_bo", "_ao")


def plateau_correct(wearable: DataFrame, ties: Sequence[str] = (), p: CleaningParams | None = None) -> DataFrame:
    """Long offsets from the beacon baseline. ``wearable`` has hpa, baseline."""
    p = p or CleaningParams()
    return _blend_runs(wearable, p.plateau_hpa, p.context_rows, p.plateau_min_rows, None, list(ties))


def residual_correct(wearable: DataFrame, ties: Sequence[str] = (), p: CleaningParams | None = None) -> DataFrame:
    """Short residual offsets; longer ones are kept and flagged."""
    p = p or CleaningParams()
    return _blend_runs(wearable, p.residual_hpa, p.context_rows, None, p.residual_max_rows, list(ties))


def cleaning_summary(cleaned: DataFrame, keys: Sequence[str] = ("session_id", "sensor")) -> DataFrame:
    """Rows, missing, out of range, corrected, preserved, changed, ranges."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    out_of_range = F.col("raw_hpa").isNotNull() & ~F.col("raw_hpa").between(MIN_HPA, MAX_HPA)
    return cleaned.groupBy(*keys).agg(
        F.count("*").alias("rows"), n(F.col("raw_hpa").isNull()).alias("raw_missing_rows"), n(out_of_range).alias("out_of_range_rows"),
        n(F.col("short_spike")).alias("short_spike_rows"), n(F.col("long_spike")).alias("long_spike_rows"), n(F.col("raw_hpa") != F.col("hpa")).alias("changed_rows"),
        n(F.col("hpa").isNull()).alias("cleaned_missing_rows"), F.min("raw_hpa").alias("raw_min"), F.max("raw_hpa").alias("raw_max"),
        F.min("hpa").alias("cleaned_min"), F.max("hpa").alias("cleaned_max"),
    ).withColumns({"out_of_range_fraction": F.col("out_of_range_rows") / F.col("rows"), "short_spike_fraction": F.col("short_spike_rows") / F.col("rows")})


def pressure_chain(wearable: DataFrame, environment: DataFrame, ties: Sequence[str] = (), p: CleaningParams | None = None) -> tuple[DataFrame, DataFrame]:
    """Beacon spikes → wearable plateaus → residuals. Returns (clean environment,
    wearable with hpa, baseline, relative and smoothed relative pressure)."""
    p = p or CleaningParams()
    env = durable(spike_correct(environment, ties=ties, p=p))
    base = beacon_baseline(env, wearable)
    w = durable(wearable.join(base, ["session_id", "ts"], "left"))
    w = plateau_correct(w, ties, p).drop("corrected", "kept_long")
    w = durable(residual_correct(w, ties, p))
    w = w.withColumn("relative", F.col("hpa") - F.col("baseline"))
    return env, rolling_median(w, "relative", "relative_smooth", 3, ties=list(ties))


# -- differences and floors -------------------------------------------------------
def pairwise_pressure(environment: DataFrame) -> DataFrame:
    """Beacon × beacon difference of median pressures within a home. The medians
    leave one row per beacon before the table meets itself."""
    levels = environment.filter("hpa is not null").groupBy("session_id", "sensor", "hpa").agg(F.count("*").alias("n"))
    med = levels.groupBy("session_id", "sensor").agg(F.percentile("hpa", F.lit(0.5), F.col("n")).alias("m"))
    a = med.select("session_id", F.col("sensor").alias("sensor_a"), F.col("m").alias("_a"))
    b = med.select("session_id", F.col("sensor").alias("sensor_b"), F.col("m").alias("_b"))
    return a.join(b, "session_id").select("session_id", "sensor_a", "sensor_b", (F.col("_a") - F.col("_b")).alias("difference"))


def floor_group_diff(differences: DataFrame, groups: DataFrame) -> DataFrame:
    """Median wearable−beacon difference per window and floor group."""
    return differences.join(groups, [c for c in ("session_id", "sensor") if c in groups.columns]).groupBy("session_id", "w", "floor").agg(
        F.percentile("diff", F.lit(0.5)).alias("group_diff")
    )


def same_floor_baseline(group_diffs: DataFrame, replicates: int = 1000) -> DataFrame:
    """Per session: K-medians centres of pooled group differences (the one nearest
    zero is same-floor), statistics of the nearest group, its bootstrap interval,
    and the gap between two floors in hPa and metres."""
    key = ["session_id"]
    g = durable(group_diffs.filter("group_diff is not null"))
    centers = kmedians_trim(g, key, "group_diff")
    first, second = F.col("centers")[0], F.col("centers")[1]
    near_first = F.abs(first) <= F.abs(second)
    mix = centers.select(
        "session_id", F.when(near_first, first).otherwise(second).alias("same_floor_baseline"), F.when(near_first, second).otherwise(first).alias("other_floor_center")
    )
    nearest = g.groupBy("session_id", "w").agg(F.min_by("group_diff", F.struct(F.abs("group_diff"), F.col("floor"))).alias("v"))
    nearest = durable(trim(nearest, key, "v"))
    q = nearest.groupBy(*key).agg(
        F.percentile("v", F.array(*[F.lit(x) for x in (0.5, 0.05, 0.25, 0.75, 0.95)])).alias("_q"), F.avg("v").alias("nearest_mean"), F.count("*").alias("nearest_samples")
    )
    mad = nearest.join(q.select("session_id", F.col("_q")[0].alias("_m")), key).groupBy(*key).agg(F.percentile(F.abs(F.col("v") - F.col("_m")), F.lit(0.5)).alias("nearest_mad"))
    two = g.groupBy("session_id", "w").agg(F.count("*").alias("c"), (F.max("group_diff") - F.min("group_diff")).alias("gap")).filter("c = 2")
    gap = trim(two, key, "gap").groupBy(*key).agg(F.percentile("gap", F.lit(0.5)).alias("floor_gap_hpa"))
    ci = bootstrap_median_ci(nearest, key, "v", replicates)
    return (
        mix.join(q, key, "left").join(mad, key, "left").join(gap, key, "left").join(ci, key, "left")
        .select(
            "session_id", "same_floor_baseline", "other_floor_center", pressure_height("same_floor_baseline").alias("same_floor_height_m"),
            F.col("_q")[0].alias("nearest_median"), "nearest_mean", "nearest_mad", F.col("_q")[1].alias("nearest_p05"), F.col("_q")[2].alias("nearest_p25"),
            F.col("_q")[3].alias("nearest_p75"), F.col("_q")[4].alias("nearest_p95"), "ci_low", "ci_high", "floor_gap_hpa",
            F.abs(pressure_height("floor_gap_hpa")).alias("floor_height_m"), "nearest_samples",
        )
    )


def baseline_adjust(differences: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per window: closest beacon after subtracting the baseline, signed sum and mean."""
    d = differences.join(baseline.select("session_id", "same_floor_baseline"), "session_id").withColumn(
        "_adj", F.abs(F.col("diff") - F.col("same_floor_baseline"))
    )
    return d.groupBy("session_id", "w").agg(
        F.min_by("sensor", F.struct(F.round("_adj", 9).alias("a"), F.col("sensor").alias("b"))).alias("closest_beacon"), F.min("_adj").alias("closest_abs_diff"),
        F.sum("diff").alias("signed_sum"), F.avg("diff").alias("signed_mean"),
    )


def floor_timeline(availability: DataFrame, group_diffs: DataFrame, baseline: DataFrame, margin_scale: float = 0.20) -> DataFrame:
    """Nearest floor per window with margin, confidence and smoothing; windows
    without environmental beacons carry no smoothed floor.

    ``availability(session_id, w, available)``."""
    from .runs import smooth_short_runs

    d = group_diffs.join(baseline.select("session_id", "same_floor_baseline"), "session_id").withColumn(
        "distance", F.round(F.abs(F.col("group_diff") - F.col("same_floor_baseline")), 12)
    )
    top = top_two(d, ["session_id", "w"], "floor", "distance", descending=False)
    t = availability.join(top, ["session_id", "w"], "left")
    t = t.withColumn("margin", F.col("second_value") - F.col("best_value")).withColumnsRenamed({"best_item": "floor", "best_value": "distance"})
    t = t.withColumn("confidence", F.when(F.col("margin").isNotNull(), F.least(F.greatest(F.col("margin") / margin_scale, F.lit(0.0)), F.lit(1.0))))
    s = smooth_short_runs(t.drop("second_item", "second_value"), "floor", "smoothed")
    s = s.withColumn("smoothed", F.when(F.col("available"), F.col("smoothed")))
    return s.withColumn("floor_observed", F.col("available") & F.col("smoothed").isNotNull())


def auto_floor_groups(
    environment: DataFrame, min_windows: int = 100, min_beacons: int = 2, min_separation: float = 0.30, min_silhouette: float = 0.75
) -> tuple[DataFrame, DataFrame]:
    """Floor groups of beacons per session from stable pressure offsets.

    ``environment(session_id, w, sensor, hpa)`` is windowed. Returns (groups:
    session_id, sensor, floor; audit: one row per session). Two or three groups
    are accepted only at storey-scale separation; otherwise one floor (no rows
    in ``groups``) with the reason in the audit. Ties and details: two groups
    win unless three score 0.05 better."""
    key = ["session_id"]
    env = durable(environment.filter("hpa is not null"))
    per_w = env.groupBy("session_id", "w").agg(F.count("*").alias("_c"), F.percentile("hpa", F.lit(0.5)).alias("_med")).filter("_c >= 2")
    size = env.select("session_id", "sensor").distinct().groupBy("session_id").agg(F.count("*").alias("beacons"))
    over = size.join(per_w.groupBy("session_id").agg(F.count("*").alias("overlap_windows")), key, "left").na.fill(0, ["overlap_windows"])
    usable = over.filter((F.col("overlap_windows") >= min_windows) & (F.col("beacons") >= 4)).select("session_id")
    rel = env.join(per_w, ["session_id", "w"]).withColumn("_rel", F.col("hpa") - F.col("_med"))
    off = durable(rel.groupBy("session_id", "sensor").agg(F.percentile("_rel", F.lit(0.5)).alias("x")).join(usable, key, "left_semi"))
    hist = durable(histogram(off, key, "x"))
    count = off.groupBy("session_id").agg(F.count("*").alias("_b"))
    model = durable(kmeans1d_ordered(hist, key, [2, 3]).join(count, key).filter(F.col("_b") >= min_beacons * F.col("k")).drop("_b"))
    sil = silhouette1d(hist, model, key)
    lab = off.join(model, key).withColumn("label", label_of(F.col("x"), F.col("uppers")))
    med = lab.groupBy("session_id", "k", "label").agg(F.percentile("x", F.lit(0.5)).alias("_m"), F.count("*").alias("_n"))
    mad = lab.join(med, ["session_id", "k", "label"]).groupBy("session_id", "k", "label").agg(F.percentile(F.abs(F.col("x") - F.col("_m")), F.lit(0.5)).alias("_mad"), F.first("_n").alias("_n"))
    pooled = mad.groupBy("session_id", "k").agg(F.greatest(F.percentile("_mad", F.lit(0.5)), F.lit(1e-6)).alias("pooled_mad"), F.min("_n").alias("smallest"))
    sep = F.array_min(F.expr("transform(sequence(1, size(centers) - 1), i -> centers[i] - centers[i - 1])"))
    c = model.join(sil, ["session_id", "k"]).join(pooled, ["session_id", "k"]).withColumn("separation", F.round(sep, 12))
    checks = {
        "silhouette": F.round("silhouette", 12) >= min_silhouette, "floor_scale_separation": F.col("separation") >= min_separation,
        "group_size": F.col("smallest") >= min_beacons, "within_group_dispersion": F.col("separation") >= 3 * F.col("pooled_mad"),
    }
    ok = F.lit(True)
    for cond in checks.values():
        ok = ok & cond
    failures = F.array_compact(F.array(*[F.when(~cond, name) for name, cond in checks.items()]))
    c = durable(c.withColumns({"valid": ok, "_fail": failures}))
    packed = c.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("silhouette", "valid", "centers", "separation", "pooled_mad", "_fail")))).alias("_by"))
    two, three = F.try_element_at("_by", F.lit(2)), F.try_element_at("_by", F.lit(3))
    v2, v3 = F.coalesce(two["valid"], F.lit(False)), F.coalesce(three["valid"], F.lit(False))
    chosen = F.when(v2 & v3, F.when(three["silhouette"] >= two["silhouette"] + 0.05, 3).otherwise(2)).when(v2, 2).when(v3, 3)
    best = F.when(three.isNull() | (two["silhouette"] >= three["silhouette"]), 2).otherwise(3)
    shown = F.coalesce(chosen, best)
    audit = over.join(packed, key, "left").withColumn("floor_k", chosen).withColumn("_shown", F.try_element_at("_by", shown))
    reason = (
        F.when(F.col("floor_k").isNotNull(), "stable_multifloor_grouping")
        .when((F.col("overlap_windows") < min_windows) | (F.col("beacons") < 4), "insufficient_overlap_or_beacons")
        .when(F.col("_by").isNull(), "k1_null_selected_no_valid_candidate")
        .otherwise(F.concat(F.lit("k1_null_selected_"), F.array_join(F.col("_shown._fail"), "_and_")))
    )
    audit = audit.select(
        "session_id", "overlap_windows", "beacons", F.coalesce("floor_k", F.lit(1)).alias("floor_k"), F.col("floor_k").isNotNull().alias("groups_valid"), reason.alias("reason"),
        F.col("_shown.silhouette").alias("silhouette"), F.col("_shown.separation").alias("min_separation"), F.col("_shown.pooled_mad").alias("pooled_mad"),
    )
    pick = audit.filter("groups_valid").select("session_id", F.col("floor_k").alias("k"))
    groups = lab.join(pick, ["session_id", "k"]).select("session_id", "sensor", F.concat(F.lit("pressure_floor_"), F.col("label")).alias("floor"))
    return groups, audit


def pressure_constraint(
    grid: DataFrame, rssi: DataFrame, environment: DataFrame, wearable: DataFrame, groups: DataFrame, moving: DataFrame | None = None,
    min_pairs: int = 20, min_confidence: float = 0.75,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Null other floors' signal where the wearable's pressure floor is trusted
    and a same-floor beacon was heard.

    ``grid(session_id, w)``, ``rssi(… beacon, rssi_mean)``, ``environment(… sensor,
    hpa)`` and ``wearable(… hpa)`` per window; ``groups(session_id, sensor, floor)``;
    ``moving(session_id, w, moving)``. Returns (constrained signal, floor columns
    per window, audit per session)."""
    key = ["session_id", "w"]
    several = groups.groupBy("session_id").agg(F.count_distinct("floor").alias("_f")).filter("_f >= 2").select("session_id")
    groups = durable(groups.join(several, "session_id", "left_semi"))
    gp = durable(environment.filter("hpa is not null").join(groups, ["session_id", "sensor"]).groupBy(*key, "floor").agg(F.percentile("hpa", F.lit(0.5)).alias("gp")))
    beacon_floor = groups.withColumnRenamed("sensor", "beacon")
    best = rssi.filter("rssi_mean is not null").groupBy(*key).agg(F.min_by("beacon", F.struct((-F.col("rssi_mean")).alias("a"), F.col("beacon").alias("b"))).alias("beacon"))
    cal = (
        best.join(beacon_floor, ["session_id", "beacon"]).join(gp, [*key, "floor"]).join(wearable.filter("hpa is not null"), key)
        .groupBy("session_id").agg(F.percentile(F.col("hpa") - F.col("gp"), F.lit(0.5)).alias("offset"), F.count("*").alias("pairs"))
    )
    enabled = durable(cal.filter(F.col("pairs") >= min_pairs))
    d = gp.join(wearable.filter("hpa is not null"), key).join(enabled.select("session_id", "offset"), "session_id").withColumn(
        "distance", F.round(F.abs(F.col("gp") - (F.col("hpa") - F.col("offset"))), 12)
    )
    top = top_two(d, key, "floor", "distance", descending=False)
    margin = F.col("second_value") - F.col("best_value")
    conf = F.least(F.greatest(margin / (margin + F.col("best_value") + 0.05), F.lit(0.0)), F.lit(1.0))
    env_any = environment.filter("hpa is not null").select(*key).distinct().withColumn("_env", F.lit(True))
    info = grid.join(top.select(*key, F.col("best_item").alias("floor"), F.when(margin.isNotNull(), conf).alias("confidence")), key, "left").join(env_any, key, "left")
    order = Window.partitionBy("session_id").orderBy("w")
    if moving is None:
        info = info.withColumn("_mv", F.lit(False))
    else:
        info = info.join(moving.select(*key, F.col("moving").alias("_mv")), key, "left").na.fill(False, ["_mv"])
    near = F.max("_mv").over(order.rowsBetween(-1, 1))
    shift = F.coalesce(F.col("floor") != F.lag("floor").over(order), F.lit(False))
    trusted = F.coalesce(F.round("confidence", 12) >= min_confidence, F.lit(False)) & (~shift | near)
    info = info.withColumn("trusted", trusted).join(enabled.select("session_id", F.lit(True).alias("_on")), "session_id", "left")
    status = (
        F.when(F.col("_on").isNull(), "inactive").when(F.col("trusted"), "trusted_same_floor_constraint").when(F.col("confidence").isNotNull(), "low_confidence_kept_raw")
        .when(F.col("_env"), "environmental_pressure_only").otherwise("inactive")
    )
    info = durable(info.select(*key, F.col("floor").alias("pressure_floor_group"), F.col("confidence").alias("pressure_floor_confidence"), F.col("trusted").alias("pressure_floor_trusted"), status.alias("pressure_status")))
    want = info.filter("pressure_floor_trusted").select(*key, F.col("pressure_floor_group").alias("_want"))
    r = rssi.join(want, key, "left").join(beacon_floor, ["session_id", "beacon"], "left")
    mine = F.coalesce(F.col("floor") == F.col("_want"), F.lit(False))
    heard = F.max(mine & F.col("rssi_mean").isNotNull()).over(Window.partitionBy(*key))
    cut = F.col("_want").isNotNull() & heard & ~mine
    constrained = r.withColumn("_cut", cut).withColumn("rssi_mean", F.when(~F.col("_cut"), F.col("rssi_mean"))).drop("_cut", "_want", "floor")
    audit = grid.select("session_id").distinct().join(cal, "session_id", "left").join(
        info.groupBy("session_id").agg(F.sum(F.col("pressure_floor_trusted").cast("bigint")).alias("trusted_windows")), "session_id", "left"
    ).withColumn("pressure_enabled", F.coalesce(F.col("pairs") >= min_pairs, F.lit(False)))
    return constrained, info, audit


# Status → confidence factor and meaning.
FLOOR_STATUS = {
    "floor_consistent": (1.0, "RSSI strongest beacon is on the pressure-inferred floor"),
    "pressure_uncertain": (0.8, "Pressure floor confidence is low; keep RSSI but flag uncertainty"),
    "acc_unsupported_floor_shift": (0.55, "Pressure floor shift lacks ACC support; keep raw RSSI"),
    "possible_cross_floor_transition": (0.75, "RSSI and pressure disagree near an ACC-supported floor shift"),
    "floor_conflict": (0.5, "RSSI and high-confidence pressure floor disagree without ACC shift support"),
    "insufficient_floor_or_rssi": (0.5, "Missing floor or RSSI evidence"),
}


def floor_aware_rssi(windows: DataFrame, cells: DataFrame, beacon_floors: DataFrame, high_confidence: float = 0.75) -> DataFrame:
    """Compare the strongest beacon's floor with the pressure floor, and switch to
    the best same-floor beacon: only where trusted, and by brute force.

    ``windows(session_id, w, strongest_beacon, strongest_rssi, pressure_floor,
    confidence, near_supported_shift, near_unsupported_shift)``;
    ``cells(session_id, w, beacon, rssi_mean)``; ``beacon_floors(beacon, floor)``."""
    key = ["session_id", "w"]
    lookup = beacon_floors.select([c for c in ("session_id",) if c in beacon_floors.columns] + ["beacon", "floor"])
    on = [c for c in ("session_id", "beacon") if c in beacon_floors.columns]
    t = windows.withColumn("beacon", F.col("strongest_beacon")).join(lookup.withColumnRenamed("floor", "beacon_floor"), on, "left").drop("beacon")
    same = (
        cells.filter("rssi_mean is not null").join(lookup, on).join(t.select(*key, "pressure_floor"), key).filter(F.col("floor") == F.col("pressure_floor"))
        .groupBy(*key)
        .agg(F.min_by(F.struct("beacon", "rssi_mean"), F.struct((-F.col("rssi_mean")).alias("a"), F.col("beacon").alias("b"))).alias("_s"))
    )
    t = t.join(same, key, "left").withColumns({"same_floor_beacon": F.col("_s.beacon"), "same_floor_rssi": F.col("_s.rssi_mean")}).drop("_s")
    no = F.lit(False)
    high = F.coalesce(F.col("confidence") >= high_confidence, no)
    low = F.coalesce(F.col("confidence") < high_confidence, no)
    t = t.withColumns(
        {
            "consistent": F.coalesce(F.col("beacon_floor") == F.col("pressure_floor"), no),
            "trusted": high & ~F.col("near_unsupported_shift"),
        }
    )
    has = F.col("same_floor_beacon").isNotNull()
    status = (
        F.when(F.col("consistent"), "floor_consistent").when(low, "pressure_uncertain").when(F.col("near_unsupported_shift"), "acc_unsupported_floor_shift")
        .when(F.col("near_supported_shift"), "possible_cross_floor_transition").when(high, "floor_conflict").otherwise("insufficient_floor_or_rssi")
    )
    switch, brute = ~F.col("consistent") & F.col("trusted") & has, ~F.col("consistent") & has
    t = t.withColumns(
        {
            "status": status, "aware_beacon": F.when(switch, F.col("same_floor_beacon")).otherwise(F.col("strongest_beacon")),
            "brute_beacon": F.when(brute, F.col("same_floor_beacon")).otherwise(F.col("strongest_beacon")), "brute_no_candidate": ~F.col("consistent") & ~has,
        }
    )
    moved = lambda c: F.coalesce(F.col(c) != F.col("strongest_beacon"), F.col(c).isNotNull())
    t = t.withColumns({"aware_changed": moved("aware_beacon"), "brute_changed": moved("brute_beacon")})
    reason = (
        F.when(F.col("aware_changed"), "switched_to_best_same_floor_beacon").when(F.col("consistent"), "raw_rssi_already_same_floor")
        .when(F.col("near_unsupported_shift"), "kept_raw_due_to_acc_unsupported_shift").when(low, "kept_raw_due_to_low_pressure_confidence").otherwise("kept_raw_no_same_floor_switch")
    )
    factor = F.create_map(*[x for k, v in FLOOR_STATUS.items() for x in (F.lit(k), F.lit(v[0]))])
    text = F.create_map(*[x for k, v in FLOOR_STATUS.items() for x in (F.lit(k), F.lit(v[1]))])
    return t.withColumns({"change_reason": reason, "confidence_factor": factor[F.col("status")], "interpretation": text[F.col("status")]})


def switch_summary(aware: DataFrame) -> DataFrame:
    """Counts and percentages of mismatches, trusted and changed windows and of
    each reason, for the trusted and the brute-force switch."""
    n = lambda c: F.sum(c.cast("bigint"))
    base = aware.groupBy("session_id").agg(
        F.count("*").alias("t"), n(~F.col("consistent")).alias("mm"), n(F.col("trusted")).alias("tr"), n(F.col("aware_changed")).alias("ch"),
        n(F.col("brute_changed")).alias("bc"), n(F.col("brute_no_candidate")).alias("nc"),
    )

    def row(name: str, count: str, per: str) -> Column:
        pct = F.when(F.col(per) > 0, 100.0 * F.col(count) / F.col(per)).otherwise(F.lit(0.0))
        return F.struct(F.lit(name).alias("metric"), F.col(count).alias("count"), pct.alias("percentage"))

    rows = F.array(
        row("total_5min_windows", "t", "t"), row("raw_strongest_rssi_pressure_floor_mismatch", "mm", "t"), row("pressure_acc_floor_trusted_windows", "tr", "t"),
        row("changed_to_best_same_floor_beacon", "ch", "t"), row("changed_as_percentage_of_mismatches", "ch", "mm"),
        row("bruteforce_changed_to_best_same_floor_beacon", "bc", "t"), row("bruteforce_changed_as_percentage_of_mismatches", "bc", "mm"),
        row("mismatch_with_no_same_floor_rssi_candidate", "nc", "mm"),
    )
    reasons = aware.groupBy("session_id", "change_reason").agg(F.count("*").alias("count")).join(base.select("session_id", "t"), "session_id").select(
        "session_id", F.concat(F.lit("change_reason__"), F.col("change_reason")).alias("metric"), "count", (100.0 * F.col("count") / F.col("t")).alias("percentage")
    )
    return base.select("session_id", F.inline(rows)).unionByName(reasons)
