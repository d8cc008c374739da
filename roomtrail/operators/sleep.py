"""Sleep episodes: dominant room, lock, gap filling, bedroom, nightly reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..env import durable
from ..functions.timefn import bins, local_ts
from ..params import InferenceParams
from .intervals import join_gap_context
from .runs import boolean_runs
from .topk import mode_label


def episode_windows(timeline: DataFrame, episodes: DataFrame, window_s: int) -> DataFrame:
    inside = episodes.select("session_id", "episode_id", F.explode(bins("start", "end", window_s)).alias("w"))
    return timeline.join(inside, ["session_id", "w"])


def episode_room(timeline: DataFrame, episodes: DataFrame, window_s: int, min_share: float = 0.60, beacon: str = "beacon", room: str = "room") -> DataFrame:
    """Dominant beacon and its room, counts, share and support flag per episode."""
    episodes = durable(episodes)
    rows = durable(episode_windows(timeline.select("session_id", "w", beacon, room), episodes, window_s))
    best = mode_label(rows, ["session_id", "episode_id"], beacon)
    rooms = rows.filter(F.col(beacon).isNotNull()).groupBy("session_id", "episode_id", beacon).agg(F.min_by(room, "w").alias("dominant_room"))
    best = best.join(rooms, ["session_id", "episode_id", beacon]).select(
        "session_id", "episode_id", F.col(beacon).alias("dominant_beacon"), "dominant_room", F.col("n").alias("dominant_count"),
        F.col("total").alias("observed_windows"), (F.col("n") / F.col("total")).alias("dominant_share"),
    )
    out = episodes.join(best, ["session_id", "episode_id"], "left").na.fill(0, ["dominant_count", "observed_windows"])
    return out.withColumn("room_supported", F.coalesce(F.col("dominant_share") >= min_share, F.lit(False)))


def gaps_in_episodes(timeline: DataFrame, episodes: DataFrame, window_s: int, beacon: str = "beacon") -> DataFrame:
    """Missing runs inside episodes that have a dominant beacon (``target``).
    Runs never cross an episode: episodes do not touch each other."""
    if "dominant_beacon" not in episodes.columns:
        episodes = episode_room(timeline, episodes, window_s, beacon=beacon)
    rows = episode_windows(timeline.select("session_id", "w", beacon), episodes, window_s)
    missing = rows.withColumn("_missing", F.col(beacon).isNull())
    found = boolean_runs(missing, "_missing", window_s).select("session_id", "start", "end")
    # the run starts inside exactly one episode: its first window names it
    starts = rows.select("session_id", F.col("w").alias("start"), "episode_id")
    info = episodes.filter("dominant_beacon is not null").select(
        "session_id", "episode_id", F.col("start").alias("episode_start"), F.col("end").alias("episode_end"), F.col("dominant_beacon").alias("target")
    )
    out = found.join(starts, ["session_id", "start"]).join(info, ["session_id", "episode_id"])
    order = Window.partitionBy("session_id").orderBy("start")
    return out.withColumn("gap_id", F.row_number().over(order))


def gap_support(gaps: DataFrame, timeline: DataFrame, window_s: int, context_s: int, min_share: float, beacon: str = "beacon") -> DataFrame:
    """Gaps with ``supported``: an observation and enough target share on both sides."""
    ctx = join_gap_context(gaps, timeline, window_s, context_s, beacon)
    ok = (F.col("before_n") >= 1) & (F.col("after_n") >= 1) & (F.col("before_share") >= min_share) & (F.col("after_share") >= min_share)
    return ctx.withColumn("supported", F.coalesce(ok, F.lit(False)))


def sleep_correction(timeline: DataFrame, episodes: DataFrame, window_s: int, params: InferenceParams | None = None) -> DataFrame:
    """Observed windows of an eligible main-sleep episode take its room; gaps
    supported from both sides are filled with it.

    ``timeline`` has base_beacon, base_room, rssi_observed; ``episodes`` has
    main_sleep, room_correction_eligible, dominant_beacon, dominant_room."""
    p = params or InferenceParams()
    main = episodes.filter("main_sleep")
    eligible = main.filter(F.col("room_correction_eligible") & F.col("dominant_beacon").isNotNull())
    timeline = durable(timeline)
    base = timeline.withColumnRenamed("base_beacon", "beacon").select("session_id", "w", "beacon")
    gaps = gap_support(
        gaps_in_episodes(base, eligible, window_s), base, window_s, p.gap_context_minutes * 60, p.context_room_share
    )
    filled = gaps.filter("supported").select("session_id", F.explode(bins("start", "end", window_s)).alias("w"), F.lit(True).alias("_fill"))
    inside = main.select(
        "session_id", F.explode(bins("start", "end", window_s)).alias("w"), F.col("episode_id").alias("sleep_episode_id"),
        (F.col("room_correction_eligible") & F.col("dominant_beacon").isNotNull()).alias("_elig"), "dominant_beacon", "dominant_room",
    )
    t = timeline.join(inside, ["session_id", "w"], "left").join(filled, ["session_id", "w"], "left")
    elig, fill = F.coalesce("_elig", F.lit(False)), F.coalesce("_fill", F.lit(False))
    locked = elig & F.col("base_beacon").isNotNull()
    taken = locked | fill
    return t.withColumns(
        {
            "main_sleep": F.col("sleep_episode_id").isNotNull(),
            "corrected_beacon": F.when(taken, F.col("dominant_beacon")).otherwise(F.col("base_beacon")),
            "corrected_room": F.when(taken, F.col("dominant_room")).otherwise(F.col("base_room")),
            "correction_reason": F.when(fill, "sleep_gap_two_sided_room_support")
            .when(locked & (F.col("base_beacon") != F.col("dominant_beacon")), "sleep_episode_dominant_room")
            .otherwise("none"),
            "location_evidence": F.when(fill, "sleep_gap_context_filled").when(locked, "sleep_episode_locked")
            .otherwise(F.when(F.col("rssi_observed"), "observed_raw").otherwise("missing")),
            "sleep_gap_filled": fill,
        }
    ).drop("_elig", "_fill", "dominant_beacon", "dominant_room")


def infer_bedroom(episodes: DataFrame, sessions: DataFrame, known: DataFrame | None = None, min_nights: int = 2, min_share: float = 0.60) -> DataFrame:
    """Bedroom beacon per session: known from the map, or a beacon supported in
    main sleep on enough local nights. ``sessions(session_id, timezone)``."""
    ok = episodes.filter("main_sleep and room_supported").join(sessions.select("session_id", "timezone"), "session_id")
    night = F.to_date(local_ts("start", F.col("timezone")))
    per = (
        ok.groupBy("session_id", "dominant_beacon")
        .agg(
            F.count_distinct(night).alias("support_nights"),
            (F.sum("dominant_count") / F.sum("observed_windows")).alias("support_share"),
            F.sum("observed_windows").alias("_total"),
        )
        .filter((F.col("support_nights") >= min_nights) & (F.col("support_share") >= min_share))
    )
    best = per.groupBy("session_id").agg(
        F.min_by(
            F.struct("dominant_beacon", "support_nights", "support_share"),
            F.struct(-F.col("support_nights"), -F.col("_total"), -F.round("support_share", 9), "dominant_beacon"),
        ).alias("_b")
    )
    out = sessions.select("session_id").join(best, "session_id", "left")
    if known is not None:
        mapped = known.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("beacon")), "|").alias("_known"))
        out = out.join(mapped, "session_id", "left")
    else:
        out = out.withColumn("_known", F.lit(None).cast("string"))
    has_known, found = F.col("_known").isNotNull(), F.col("_b").isNotNull()
    return out.select(
        "session_id",
        F.when(has_known, "metadata").when(found, "inferred_cross_night").otherwise("unresolved").alias("bedroom_source"),
        F.coalesce("_known", F.when(found, F.col("_b.dominant_beacon")), F.lit("")).alias("bedroom_beacons"),
        (~has_known & found).alias("bedroom_inferred"),
        F.when(~has_known, F.col("_b.support_nights")).alias("support_nights"),
        F.when(~has_known, F.col("_b.support_share")).alias("support_share"),
    )


def nightly_summary(episodes: DataFrame) -> DataFrame:
    """Per evening: episodes, minutes, and the longest episode's details
    (ties: the earlier one)."""
    return episodes.groupBy("session_id", "night").agg(
        F.count("*").alias("episode_count"),
        F.sum("duration_minutes").alias("total_minutes"),
        F.max_by(
            F.struct("duration_minutes", "start", "end", "dominant_beacon", "dominant_share"),
            F.struct("duration_minutes", -F.unix_micros("start")),
        ).alias("_l"),
    ).select(
        "session_id", "night", "episode_count", "total_minutes", F.col("_l.duration_minutes").alias("longest_minutes"),
        F.col("_l.start").alias("longest_start"), F.col("_l.end").alias("longest_end"),
        F.col("_l.dominant_beacon").alias("longest_beacon"), F.col("_l.dominant_share").alias("longest_share"),
    )


def beacon_ranking(episodes: DataFrame) -> DataFrame:
    """Beacons by nights present, minutes and mean share, with share of minutes."""
    per = episodes.groupBy("session_id", "dominant_beacon").agg(
        F.count("*").alias("episode_count"), F.sum("duration_minutes").alias("total_minutes"),
        F.avg("dominant_share").alias("mean_share"), F.count_distinct("night").alias("nights_present"),
    )
    session = Window.partitionBy("session_id")
    order = session.orderBy(F.desc("nights_present"), F.desc("total_minutes"), F.desc(F.round("mean_share", 9)), "dominant_beacon")
    return per.withColumns(
        {"minutes_fraction": F.col("total_minutes") / F.sum("total_minutes").over(session), "rank": F.row_number().over(order)}
    )


def clock_label(noon_minutes: Column) -> Column:
    minute = F.pmod(F.bround(noon_minutes + 720, 0).cast("int"), F.lit(1440))
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), minute % 60)


def episode_clock_boundary(episodes: DataFrame, padding_minutes: float = 60) -> DataFrame:
    """Clock labels around the episodes: 5th percentile of starts and 95th of
    ends on a noon-anchored day, padded."""

    def noon_minutes(c: str) -> Column:
        return F.pmod(F.hour(c) * 60 + F.minute(c) - 720, F.lit(1440)).cast("double")

    per = episodes.groupBy("session_id").agg(
        F.percentile(noon_minutes("start"), F.lit(0.05)).alias("a"), F.percentile(noon_minutes("end"), F.lit(0.95)).alias("b")
    )
    return per.select(
        "session_id", clock_label(F.col("a") - padding_minutes).alias("boundary_start"), clock_label(F.col("b") + padding_minutes).alias("boundary_end")
    )
