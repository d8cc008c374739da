"""Choosing the averaging window from movement and signal evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..env import durable
from .runs import transition_count_missing

# Movement state → window seconds.
WINDOW_OF_STATE = {"stationary": 1800, "low_movement": 600, "active": 300, "high_activity": 60}


def window_by_steps(aligned: DataFrame, thresholds: Sequence[float], sizes_s: Sequence[int], fallback_s: int, steps: str = "steps") -> DataFrame:
    """First window (in the order of ``sizes_s``) whose steps are at most the
    threshold, else ``fallback_s``; one row per (row, threshold).

    ``aligned`` carries ``<steps>_<minutes>m`` columns from ``align_floor``."""
    rows = aligned.withColumn("threshold_steps", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    choice = F.lit(int(fallback_s))
    for s in reversed(sizes_s):
        choice = F.when(F.coalesce(F.col(f"{steps}_{s // 60}m") <= F.col("threshold_steps"), F.lit(False)), F.lit(int(s))).otherwise(choice)
    return rows.withColumn("selected_window", choice).withColumn("possible_transition", F.col("selected_window") == fallback_s)


def pick_sized(rows: DataFrame, values: Sequence[str], sizes_s: Sequence[int], selected: str = "selected_window") -> DataFrame:
    """Value columns of the selected window size (``<value>_<minutes>m``)."""

    def pick(v: str) -> Column:
        out = F.lit(None)
        for s in sizes_s:
            out = F.when(F.col(selected) == s, F.col(f"{v}_{s // 60}m")).otherwise(out)
        return out

    return rows.withColumns({v: pick(v) for v in values})


def window_by_stability(
    rows: DataFrame, sizes_s: Sequence[int], max_steps: Sequence[float], min_dominance: Sequence[float], min_gap: Sequence[float], fallback_s: int
) -> DataFrame:
    """Window whose steps, dominance and gap all pass; missing evidence counts 0."""
    choice = F.lit(int(fallback_s))
    for s, st, do, ga in reversed(list(zip(sizes_s, max_steps, min_dominance, min_gap))):
        m = f"{s // 60}m"
        zero = F.lit(0.0)
        ok = (F.coalesce(f"steps_{m}", zero) <= st) & (F.coalesce(f"dominance_{m}", zero) >= do) & (F.coalesce(f"gap_db_{m}", zero) >= ga)
        choice = F.when(ok, F.lit(int(s))).otherwise(choice)
    return rows.withColumn("stability_window", choice)


def predict_selected_window(anchors: DataFrame, sized: DataFrame, selected: str = "selected_window", prediction: str = "predicted") -> DataFrame:
    """Prediction of the selected window size holding each anchor ``w``:
    one equi-join on (session, size, floored time)."""
    width = F.col(selected).cast("bigint") * 1_000_000
    probe = anchors.withColumn("_w", F.timestamp_micros(F.floor(F.unix_micros("w") / width).cast("bigint") * width))
    table = sized.select("session_id", F.col("window_s").cast("int").alias(selected), F.col("w").alias("_w"), prediction)
    return probe.join(table, ["session_id", selected, "_w"], "left").drop("_w")


def stationary_thresholds(rows: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Coverage, steps, confidence, in-home share and room changes of the rows
    at or under each threshold. ``rows(session_id, w, steps, confidence, in_home, room)``."""
    rows = durable(rows)
    arr = F.array(*[F.lit(float(t)) for t in thresholds])
    total = rows.groupBy(*keys).agg(F.count("*").alias("_all"))
    still = rows.withColumn("threshold_steps", F.explode(F.filter(arr, lambda t: F.col("steps") <= t)))
    on = [*keys, "threshold_steps"]
    agg = still.groupBy(*on).agg(
        F.count("*").alias("stationary_windows"), F.avg("steps").alias("mean_steps"), F.avg("confidence").alias("mean_confidence"),
        F.avg(F.col("in_home").cast("int")).alias("in_home_fraction"),
    )
    dim = total.select(*keys, "_all", F.explode(arr).alias("threshold_steps"))
    moves = transition_count_missing(still, "room", on)
    return (
        dim.join(agg, on, "left").join(moves, on, "left").na.fill(0, ["stationary_windows", "transitions"])
        .withColumn("coverage", F.col("stationary_windows") / F.col("_all")).drop("_all")
    )


def select_stationary_threshold(comparison: DataFrame, target_coverage: float = 0.35) -> DataFrame:
    """Score per threshold over all roles and mark the best one (``selected``).
    One row per threshold enters the ranking, so plain windows rank them."""
    s = comparison.groupBy("threshold_steps").agg(
        F.avg("coverage").alias("mean_coverage"), F.avg("mean_confidence").alias("mean_confidence"), F.avg(F.col("transitions").cast("double")).alias("mean_transitions")
    ).withColumns({"_c": F.round("mean_confidence", 9), "_t": F.round("mean_transitions", 9)})
    few = Window.partitionBy(F.lit(1))

    def share_rank(c: str) -> Column:
        ties = F.count("*").over(Window.partitionBy(F.lit(1), c))
        rank = F.rank().over(few.orderBy(c)) + (ties - 1) / 2
        return F.when(F.col(c).isNotNull(), rank / F.count(c).over(few))

    s = s.withColumns({"confidence_score": share_rank("_c"), "_tr": share_rank("_t")})
    s = s.withColumns({"coverage_score": 1 - F.abs(F.col("mean_coverage") - target_coverage), "transition_score": 1 - F.col("_tr")})
    score = 0.40 * F.col("coverage_score") + 0.35 * F.col("confidence_score") + 0.25 * F.col("transition_score")
    s = s.withColumn("selection_score", score)
    best = F.max_by("threshold_steps", F.struct(F.round("selection_score", 9), -F.col("threshold_steps"))).over(few)
    return s.withColumn("selected", F.col("threshold_steps") == best).drop("_c", "_t", "_tr")


def movement_cuts(rows: DataFrame, stationary_max: float, keys: Sequence[str] = ("session_id",), steps: str = "steps") -> DataFrame:
    """Low/active/high cuts from the steps above the stationary threshold: the
    median (75th percentile when the median is the minimum) and the 90th."""
    moving = rows.filter(F.col(steps) > stationary_max)
    q = moving.groupBy(*keys).agg(F.percentile(steps, F.array(*[F.lit(p) for p in (0.5, 0.75, 0.9)])).alias("_q"), F.min(steps).alias("_min"))
    low = F.when(F.col("_q")[0] <= F.col("_min"), F.col("_q")[1]).otherwise(F.col("_q")[0])
    return rows.select(*keys).distinct().join(q, list(keys), "left").select(
        *keys, F.lit(float(stationary_max)).alias("stationary_max"), low.alias("low_max"), F.col("_q")[2].alias("active_max")
    )


def movement_state(rows: DataFrame, cuts: DataFrame, keys: Sequence[str] = ("session_id",), steps: str = "steps") -> DataFrame:
    state = (
        F.when(F.col(steps) <= F.col("stationary_max"), "stationary").when(F.col(steps) <= F.col("low_max"), "low_movement")
        .when(F.col(steps) <= F.col("active_max"), "active").otherwise("high_activity")
    )
    return rows.join(cuts, list(keys)).withColumn("movement_state", state)


def adaptive_by_state(rows: DataFrame, values: Sequence[str], windows: dict[str, int] | None = None) -> DataFrame:
    """Window per movement state, possible-transition flag, and the values of
    the selected window."""
    windows = windows or WINDOW_OF_STATE
    sel = F.lit(None).cast("int")
    for state, s in windows.items():
        sel = F.when(F.col("movement_state") == state, F.lit(int(s))).otherwise(sel)
    out = rows.withColumn("selected_window", sel).withColumn("possible_transition", F.col("movement_state") == "high_activity")
    return pick_sized(out, values, list(windows.values()))


def step_threshold_diag(windows: DataFrame, thresholds: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Counts and shares at or under each threshold, with missing windows
    excluded and as zero, plus quantiles of valid windows.
    ``windows(keys…, steps_in_window, step_samples)``."""
    valid = F.col("step_samples") > 0
    v = F.when(valid, F.col("steps_in_window"))
    agg = windows.groupBy(*keys).agg(
        F.count("*").alias("total_windows"), F.sum(valid.cast("bigint")).alias("valid_windows"), F.avg(v).alias("mean_steps"),
        F.percentile(v, F.array(*[F.lit(p) for p in (0.5, 0.75, 0.9)])).alias("_q"), F.max(v).alias("max_steps"),
        *[F.sum(F.coalesce((v <= t), F.lit(False)).cast("bigint")).alias(f"_c{i}") for i, t in enumerate(thresholds)],
    )
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold_steps"), F.col(f"_c{i}").alias("count_lte")) for i, t in enumerate(thresholds)])
    out = agg.select(*keys, "total_windows", "valid_windows", "mean_steps", "_q", "max_steps", F.inline(rows))
    missing = F.col("total_windows") - F.col("valid_windows")
    return out.select(
        *keys, "threshold_steps", "total_windows", "valid_windows", missing.alias("missing_windows"), "count_lte",
        F.when(F.col("valid_windows") > 0, F.col("count_lte") / F.col("valid_windows")).alias("share_lte"),
        (F.col("count_lte") + missing).alias("count_lte_missing_zero"), ((F.col("count_lte") + missing) / F.col("total_windows")).alias("share_lte_missing_zero"),
        "mean_steps", F.col("_q")[0].alias("median_steps"), F.col("_q")[1].alias("p75_steps"), F.col("_q")[2].alias("p90_steps"), "max_steps",
    )


def window_choice_distribution(rows: DataFrame, choices: Sequence, keys: Sequence[str], selected: str = "selected_window") -> DataFrame:
    """Count and share of each window choice, zeros included."""
    per = rows.groupBy(*keys, selected).agg(F.count("*").alias("n"))
    total = per.groupBy(*keys).agg(F.sum("n").alias("t"))
    dim = total.select(*keys, "t", F.explode(F.array(*[F.lit(c) for c in choices])).alias(selected))
    n = F.coalesce("n", F.lit(0))
    return dim.join(per, [*keys, selected], "left").select(*keys, selected, n.alias("windows"), (n / F.col("t")).alias("fraction"))


def hybrid_override(
    rows: DataFrame, low_motion_window_s: int = 1800, min_training: int = 10, min_cluster_gap: float = 8.0, weak_gap: float = 5.0, strong_gap: float = 8.0
) -> DataFrame:
    """Use the cluster's room only in a low-motion window with a usable cluster
    and weak base evidence; ``reason`` says which rule decided.

    ``rows`` has base_room, base_gap, base_samples, selected_window,
    cluster_room, training_windows, cluster_gap."""
    base = F.coalesce("base_room", F.lit("Unmapped"))
    cluster = F.coalesce("cluster_room", F.lit("Unmapped"))
    off = ("Unmapped", "Out")
    no = F.lit(False)
    usable = ~cluster.isin(*off) & F.coalesce(F.col("training_windows") >= min_training, no) & F.coalesce(F.col("cluster_gap") >= min_cluster_gap, no)
    weak = F.col("base_gap").isNull() | (F.col("base_gap") < weak_gap) | base.isin(*off) | F.coalesce(F.col("base_samples") <= 0, F.lit(True))
    strong = F.coalesce(F.col("base_gap") >= strong_gap, no)
    reason = (
        F.when(~F.coalesce(F.col("selected_window") == low_motion_window_s, no), "not_30min_low_motion")
        .when(~usable, "cluster_not_usable")
        .when(strong, "strong_4b_evidence")
        .when(weak, "low_motion_weak_4b")
        .otherwise("4b_not_ambiguous")
    )
    out = rows.withColumn("reason", reason).withColumn("override_used", F.col("reason") == "low_motion_weak_4b")
    return out.withColumn("final_room", F.when(F.col("override_used"), cluster).otherwise(base)).withColumn(
        "final_source", F.when(F.col("override_used"), "cluster_override").otherwise("step_adaptive_rssi")
    )
