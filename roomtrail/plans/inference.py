"""The whole chain from window tables to timeline, episodes, away runs, audit.

One plan serves all sessions. Tables with several consumers (timeline, episode
list) are cut with durable checkpoints, so raw samples are read once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..env import durable
from ..functions.timefn import bins
from ..operators import runs, sleep, states, topk
from ..operators.cluster import classify_movement
from ..operators.filters import location_provenance
from ..params import LOOKBACK_MINUTES, InferenceParams


@dataclass
class Inference:
    timeline: DataFrame
    episodes: DataFrame
    away_runs: DataFrame
    movement_diagnostics: DataFrame
    sleep_diagnostics: DataFrame
    bedroom: DataFrame
    audit: DataFrame


def run_inference(
    grid: DataFrame, rssi: DataFrame, movement: DataFrame, online: DataFrame, beacons: DataFrame, sessions: DataFrame,
    params: InferenceParams | None = None, base_rssi: DataFrame | None = None, context: DataFrame | None = None,
    lookback: dict | None = None,
) -> Inference:
    """``grid(session_id, w)``; ``rssi(session_id, w, beacon, rssi_mean, rssi_cnt)``;
    ``movement(session_id, w, movement_value, movement_source)``;
    ``online(session_id, w, wearable_online)``; ``beacons(session_id, beacon, room)``;
    ``sessions(session_id, timezone)``. ``base_rssi`` is the signal after an
    optional pressure constraint, ``context`` its floor columns per window."""
    p = params or InferenceParams()
    w_s = p.window_s
    key = ["session_id", "w"]
    base_rssi = rssi if base_rssi is None else base_rssi

    def strongest(cells: DataFrame, prefix: str) -> DataFrame:
        top = topk.strongest_beacon(cells, beacons)
        return top.select(*key, F.col("strongest_beacon").alias(f"{prefix}_beacon"), F.col("room").alias(f"{prefix}_room"), *(
            ["rssi_sample_count", "rssi_available_beacons", F.col("rssi_observed"), "strongest_rssi", "second_rssi", "gap_db"] if prefix == "raw" else []
        ))

    # 1. signal and movement on the grid
    moved, movement_diag = classify_movement(durable(grid.join(movement, key, "left")), p)
    t = moved.join(strongest(rssi, "raw"), key, "left").join(online, key, "left")
    if base_rssi is rssi:
        t = t.withColumns({"base_beacon": F.col("raw_beacon"), "base_room": F.col("raw_room")})
    else:
        t = t.join(strongest(base_rssi, "base"), key, "left")
    if context is not None:
        t = t.join(context, key, "left")
    t = t.na.fill(False, ["rssi_observed", "wearable_online"]).na.fill(0, ["rssi_sample_count", "rssi_available_beacons"])
    changed = F.coalesce("base_beacon", F.lit("")) != F.coalesce("raw_beacon", F.lit(""))
    t = durable(t.withColumn("pressure_constrained", changed))

    # 2. sleep candidates, main sleep, room evidence, bedroom
    bouts = runs.bridged_bouts(t, "low_motion", w_s, p.max_motion_interruption_minutes * 60, p.min_sleep_candidate_minutes, p.min_sleep_low_motion_share)
    episodes, sleep_diag = states.main_sleep(durable(bouts.withColumnRenamed("candidate_id", "episode_id")), p)
    based = t.select(*key, F.col("base_beacon").alias("beacon"), F.col("base_room").alias("room"))
    episodes = durable(sleep.episode_room(based, episodes, w_s, p.room_dominance_share))
    known = beacons.filter("room = 'Bedroom'")
    bedroom = durable(sleep.infer_bedroom(episodes, sessions, known.select("session_id", "beacon") if "session_id" in beacons.columns else _spread(known, sessions)))
    inferred = bedroom.filter("bedroom_inferred").select("session_id", F.col("bedroom_beacons").alias("_bed"))
    episodes = episodes.join(inferred, "session_id", "left").withColumn(
        "dominant_room", F.when(F.col("dominant_beacon") == F.col("_bed"), "Bedroom").otherwise(F.col("dominant_room"))
    )
    source = moved.groupBy("session_id").agg(F.max("movement_source").alias("_source"))
    eligible = F.col("room_supported") & ((F.coalesce("_source", F.lit("")) != "step") | F.coalesce(F.col("dominant_room") == "Bedroom", F.lit(False)))
    episodes = durable(episodes.join(source, "session_id", "left").withColumn("room_correction_eligible", eligible).drop("_bed", "_source"))

    # 3. sleep lock and gap filling
    candidate = episodes.select("session_id", F.explode(bins("start", "end", w_s)).alias("w"), F.lit(True).alias("sleep_candidate"))
    resolved = episodes.groupBy("session_id").agg(F.bool_or("sleep_resolved").alias("sleep_resolved"))
    t = t.join(candidate, key, "left").join(resolved, "session_id", "left").na.fill(False, ["sleep_candidate", "sleep_resolved"])
    t = sleep.sleep_correction(t, episodes, w_s, p)
    # an inferred Bedroom renames the base room; unlocked windows keep the name they were mapped to
    t = t.join(inferred, "session_id", "left").withColumn("base_room", F.when(F.col("base_beacon") == F.col("_bed"), "Bedroom").otherwise(F.col("base_room")))
    t = durable(t)

    # 4. away and states
    away, _ = states.away_runs(t, p)
    away = durable(away)
    out = away.filter("probable_away").select("session_id", F.explode(bins("start", "end", w_s)).alias("w"), F.lit(True).alias("probable_away"))
    t = t.join(out, key, "left").na.fill(False, ["probable_away"])
    t = t.withColumn("occupancy_state", states.occupancy_state())
    any_resolved = moved.groupBy("session_id").agg(F.bool_or("movement_resolved").alias("_mr"))
    t = t.drop("movement_resolved").join(any_resolved, "session_id").withColumnRenamed("_mr", "movement_resolved")
    t = durable(t.withColumn("behaviour_state", states.behaviour_state()))

    # 5. awake look-back
    adapted = runs.adaptive_awake_rssi(t, base_rssi, lookback or LOOKBACK_MINUTES, w_s)
    adapted = topk.attach_room(adapted, beacons, "adaptive_beacon", "_aroom")
    t = t.join(adapted, key, "left")
    hit = F.col("adaptive_beacon").isNotNull()
    room = F.when(F.col("adaptive_beacon") == F.col("_bed"), "Bedroom").otherwise(F.col("_aroom"))
    t = t.withColumns(
        {
            "corrected_beacon": F.coalesce("adaptive_beacon", "corrected_beacon"),
            "corrected_room": F.when(hit, room).otherwise(F.col("corrected_room")),
            "location_evidence": F.when(hit, "awake_adaptive").otherwise(F.col("location_evidence")),
            "correction_reason": F.when(hit & (F.col("adaptive_beacon") != F.col("base_beacon")), "awake_movement_adaptive_rssi").otherwise(F.col("correction_reason")),
        }
    ).drop("adaptive_beacon", "_aroom", "_bed")
    t = location_provenance(states.awake_missing_rule(t))
    t = durable(t)

    # 6. audit
    sleep_audit = episodes.groupBy("session_id").agg(F.bool_or("sleep_resolved").alias("sleep_resolved"), F.sum(F.col("main_sleep").cast("bigint")).alias("main_sleep_episode_count"))
    away_audit = away.groupBy("session_id").agg(
        F.bool_or("away_resolved").alias("away_resolved"), F.count("*").alias("away_run_count"), F.sum(F.col("probable_away").cast("bigint")).alias("probable_away_run_count")
    )
    move_audit = moved.groupBy("session_id").agg(
        F.max("movement_source").alias("movement_source"), F.max("movement_k").alias("movement_k"), F.max("low_motion_threshold").alias("low_motion_threshold")
    )
    audit = states.session_audit(t, w_s, [sleep_audit, away_audit, move_audit, bedroom])
    return Inference(t, episodes, away, movement_diag, sleep_diag, bedroom, audit)


def _spread(known: DataFrame, sessions: DataFrame) -> DataFrame:
    """A session-independent beacon list for every session."""
    one = known.select("beacon").withColumn("_one", F.lit(1))
    return sessions.select("session_id").withColumn("_one", F.lit(1)).join(one, "_one").drop("_one")
