"""Main sleep, away, occupancy and behaviour states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from ..params import InferenceParams
from .cluster import assign_state, choose_ordered_clustering
from .runs import boolean_runs


def main_sleep(candidates: DataFrame, params: InferenceParams) -> tuple[DataFrame, DataFrame]:
    """Cluster log durations per session; the longest class is main sleep.
    Returns (episodes with duration_cluster, main_sleep, sleep_resolved; diagnostics)."""
    rows = candidates.withColumn("_x", F.log("duration_minutes"))
    models, diag = choose_ordered_clustering(
        rows, ["session_id"], "_x", params.sleep_candidates, params.sleep_min_per_cluster, 0.0, params.sleep_silhouette_min, params.near_best_silhouette,
        params.sleep_silhouette_borderline_min, params.sleep_borderline_center_ratio,
    )
    out = assign_state(rows, models, ["session_id"], "_x", "duration_cluster")
    return out.withColumns(
        {
            "sleep_resolved": F.col("duration_cluster_k").isNotNull(),
            "main_sleep": F.coalesce(F.col("duration_cluster") == F.col("duration_cluster_k"), F.lit(False)),
        }
    ).drop("_x", "duration_cluster_centers"), diag


def away_runs(timeline: DataFrame, params: InferenceParams) -> tuple[DataFrame, DataFrame]:
    """Runs without signal while the wearable is online and not in main sleep;
    with enough runs, the longer of two duration classes is probable away.
    Returns (runs with probable_away, away_resolved; diagnostics)."""
    gone = ~F.col("rssi_observed") & F.coalesce("wearable_online", F.lit(False)) & ~F.col("main_sleep")
    runs = boolean_runs(timeline.withColumn("_gone", gone), "_gone", params.window_s)
    n = F.count("*").over(Window.partitionBy("session_id"))
    rows = runs.withColumns({"_n": n, "_x": F.log("duration_minutes")})
    models, diag = choose_ordered_clustering(
        rows.filter(F.col("_n") >= params.away_min_runs), ["session_id"], "_x", (2,), params.away_min_per_cluster, 0.0, params.away_silhouette_min, 0.0,
        params.away_silhouette_borderline_min, params.away_center_ratio,
    )
    apart = F.exp(F.col("centers")[1]) >= params.away_center_ratio * F.exp(F.col("centers")[0])
    models = models.filter(apart)
    out = assign_state(rows, models, ["session_id"], "_x", "duration_cluster")
    return out.withColumns(
        {
            "away_resolved": F.col("duration_cluster_k").isNotNull(),
            "probable_away": F.coalesce(F.col("duration_cluster") == 2, F.lit(False)),
        }
    ).drop("_x", "_n", "duration_cluster_centers", "duration_cluster_k"), diag


def occupancy_state() -> Column:
    """From rssi_observed, probable_away, sleep_gap_filled; the last rule that
    applies wins, so it is tested first."""
    return (
        F.when(F.col("sleep_gap_filled"), "indoor_inferred_sleep").when(F.col("probable_away"), "probable_away")
        .when(F.col("rssi_observed"), "indoor_observed").otherwise("unknown")
    )


def behaviour_state() -> Column:
    """From occupancy_state, main_sleep, sleep_candidate, sleep_resolved and
    movement_resolved."""
    return (
        F.when(F.col("occupancy_state") == "probable_away", "away").when(F.col("main_sleep"), "main_sleep")
        .when(F.col("sleep_candidate") & ~F.col("main_sleep") & ~F.col("sleep_resolved"), "sleep_unresolved")
        .otherwise(F.when(F.col("movement_resolved"), "awake").otherwise("movement_unresolved"))
    )


def awake_missing_rule(timeline: DataFrame) -> DataFrame:
    """Awake windows without signal keep no room."""
    clear = F.col("behaviour_state").isin("awake", "movement_unresolved") & ~F.col("rssi_observed")
    return timeline.withColumns({c: F.when(~clear, F.col(c)) for c in ("corrected_beacon", "corrected_room")})


def session_audit(timeline: DataFrame, window_s: int, extra: list[DataFrame] | None = None) -> DataFrame:
    """One row per session: windows, observed and corrected shares, corrections,
    fills, room changes before and after, plus any per-session tables."""
    from .runs import transition_count

    base = timeline.groupBy("session_id").agg(
        F.count("*").alias("window_count"), F.avg(F.col("rssi_observed").cast("int")).alias("raw_observed_fraction"),
        F.avg(F.col("corrected_beacon").isNotNull().cast("int")).alias("corrected_observed_fraction"),
        F.sum((F.coalesce("corrected_beacon", F.lit("")) != F.coalesce("raw_beacon", F.lit(""))).cast("bigint")).alias("corrected_window_count"),
        F.sum(F.col("sleep_gap_filled").cast("bigint")).alias("sleep_gap_filled_windows"),
    )
    out = base.join(transition_count(timeline, "raw_room", window_s, "raw_transition_count"), "session_id")
    out = out.join(transition_count(timeline, "corrected_room", window_s, "corrected_transition_count"), "session_id")
    for table in extra or []:
        out = out.join(table, "session_id", "left")
    return out
