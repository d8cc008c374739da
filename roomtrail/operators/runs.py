"""Runs, islands, transitions and centred windows on session window grids.

Inputs here are window tables: one row per (session, window), already
aggregated, so a session's length is its recording time over the window width
and an ordered window per session stays small. Rolling functions on raw rows
use row halos (:func:`with_halo`)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..env import durable
from ..functions.timefn import bins, is_night, minutes_between, shift_ts, sleep_night
from .ordered import Ordered
from .topk import mode_label

def _session():
    return Window.partitionBy("session_id").orderBy("w")


def _step(window_s: int) -> Column:
    return (F.unix_micros("w") - F.unix_micros(F.lag("w").over(_session()))) == window_s * 1_000_000


def _island(df: DataFrame, new_run: Column) -> DataFrame:
    upto = _session().rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_new", F.coalesce(new_run, F.lit(True)).cast("int"))
    return marked.withColumn("_island", F.sum("_new").over(upto)).drop("_new")


def boolean_runs(df: DataFrame, flag: str, window_s: int) -> DataFrame:
    """Maximal runs of true windows exactly one step apart → ``[start, end)``."""
    on = df.filter(F.coalesce(F.col(flag), F.lit(False)))
    runs = _island(on, ~_step(window_s)).groupBy("session_id", "_island").agg(
        F.min("w").alias("start"), F.max("w").alias("_last"), F.count("*").alias("windows")
    )
    return _numbered(
        runs.select("session_id", "start", shift_ts("_last", window_s).alias("end"), "windows"), "run_id"
    )


def _numbered(df: DataFrame, name: str) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy("start")
    return df.withColumn("duration_minutes", minutes_between("start", "end")).withColumn(
        name, F.row_number().over(order)
    )


def label_runs(df: DataFrame, value: str, window_s: int) -> DataFrame:
    """Rows with ``_island`` numbering maximal runs of equal ``value`` (missing is
    its own value) broken by time gaps."""
    same = F.col(value).eqNullSafe(F.lag(value).over(_session()))
    return _island(df, ~(same & _step(window_s)))


def state_runs(df: DataFrame, value: str, window_s: int) -> DataFrame:
    """Runs of equal non-empty ``value`` as ``[start, end)``."""
    runs = (
        label_runs(df, value, window_s)
        .filter(F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
        .groupBy("session_id", "_island", value)
        .agg(F.min("w").alias("start"), F.max("w").alias("_last"), F.count("*").alias("windows"))
    )
    return _numbered(runs.select("session_id", value, "start", shift_ts("_last", window_s).alias("end"), "windows"), "run_id")


def observed_segments(df: DataFrame, observed: str, window_s: int) -> DataFrame:
    """``segment_id`` for observed rows; grows when the previous observed window
    is not exactly one step earlier."""
    seen = _island(df.filter(F.coalesce(F.col(observed), F.lit(False))).select("session_id", "w"), ~_step(window_s))
    return df.join(seen.withColumnRenamed("_island", "segment_id"), ["session_id", "w"], "left")


def bridged_bouts(
    df: DataFrame, flag: str, window_s: int, interruption_s: int = 900, min_minutes: float = 60, min_share: float | None = 0.60
) -> DataFrame:
    """Low-motion windows at most ``interruption_s`` plus one window apart form a
    bout; kept when long enough and (optionally) mostly low motion."""
    df = durable(df.select("session_id", "w", flag))
    low = df.filter(F.coalesce(F.col(flag), F.lit(False))).select("session_id", "w")
    apart = F.unix_micros("w") - F.unix_micros(F.lag("w").over(_session()))
    bouts = (
        _island(low, apart > (interruption_s + window_s) * 1_000_000)
        .groupBy("session_id", "_island")
        .agg(F.min("w").alias("start"), F.max("w").alias("_last"), F.count("*").alias("_low"))
        .select("session_id", "start", shift_ts("_last", window_s).alias("end"), "_low")
        .withColumn("duration_minutes", minutes_between("start", "end"))
        .filter(F.col("duration_minutes") >= min_minutes)
    )
    # rows of the timeline inside each bout: explode the bout, equi-join
    inside = bouts.select("session_id", "start", F.explode(bins("start", "end", window_s)).alias("w"))
    rows = inside.join(df.select("session_id", "w"), ["session_id", "w"]).groupBy("session_id", "start").agg(
        F.count("*").alias("_rows")
    )
    out = bouts.join(rows, ["session_id", "start"]).withColumn("low_motion_share", F.col("_low") / F.col("_rows"))
    if min_share is not None:
        out = out.filter(F.col("low_motion_share") >= min_share)
    return _numbered(out.drop("_low", "_rows"), "candidate_id")


def night_runs(
    df: DataFrame, flag: str, window_s: int, start_hour: int = 22, end_hour: int = 7, min_minutes: float = 60,
    local: str = "w", split_nights: bool = False, beacon: str | None = None,
) -> DataFrame:
    """Strictly contiguous low-motion night windows of at least ``min_minutes``.
    With ``split_nights`` runs also end where the evening date changes; with
    ``beacon`` a window needs a beacon to count."""
    on = F.coalesce(F.col(flag), F.lit(False)) & is_night(local, start_hour, end_hour)
    if beacon is not None:
        on = on & F.col(beacon).isNotNull()
    rows = df.filter(on).withColumn("night", sleep_night(local))
    new = ~_step(window_s)
    if split_nights:
        new = new | (F.col("night") != F.lag("night").over(_session()))
    runs = _island(rows, new).groupBy("session_id", "_island").agg(
        F.min("w").alias("start"), F.max("w").alias("_last"), F.min("night").alias("night"), F.count("*").alias("windows")
    )
    runs = runs.select("session_id", "night", "start", shift_ts("_last", window_s).alias("end"), "windows")
    return _numbered(runs, "episode_id").filter(F.col("duration_minutes") >= min_minutes)


def floor_segments(df: DataFrame, floor: str, window_s: int, medians: Sequence[str]) -> DataFrame:
    """Row-adjacent runs of equal floor with medians of the evidence columns."""
    same = F.col(floor).eqNullSafe(F.lag(floor).over(_session()))
    runs = (
        _island(df, ~same)
        .filter(F.col(floor).isNotNull())
        .groupBy("session_id", "_island", floor)
        .agg(
            F.min("w").alias("start"), F.max("w").alias("end"), F.count("*").alias("windows"),
            *[F.percentile(m, F.lit(0.5)).alias(f"median_{m}") for m in medians],
        )
    )
    return runs.withColumn("duration_minutes", F.col("windows") * (window_s / 60.0)).drop("_island")


def smooth_short_runs(df: DataFrame, value: str, output: str, max_rows: int = 2) -> DataFrame:
    """Runs of at most ``max_rows`` rows between equal neighbours take the
    neighbours' value, applied left to right.

    A change makes the next run equal to its left neighbour, so that run cannot
    change; a run after an unchanged one sees original values. Hence within each
    stretch of consecutive candidate runs exactly the 1st, 3rd, 5th … change,
    which needs two window passes over runs and no sequential fold."""
    same = F.col(value).eqNullSafe(F.lag(value).over(_session()))
    rows = _island(df, ~same)
    runs = rows.groupBy("session_id", "_island").agg(F.first(value).alias("_v"), F.count("*").alias("_n"))
    order = Window.partitionBy("session_id").orderBy("_island")
    before, after = F.lag("_v").over(order), F.lead("_v").over(order)
    candidate = F.coalesce(
        (F.col("_n") <= max_rows) & F.col("_v").isNotNull() & (before == after) & (before != F.col("_v")), F.lit(False)
    )
    runs = runs.withColumn("_cand", candidate).withColumn("_before", before)
    stretch = F.sum((~F.col("_cand")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("_stretch", stretch)
    nth = F.row_number().over(Window.partitionBy("session_id", "_stretch", "_cand").orderBy("_island"))
    runs = runs.withColumn("_new", F.when(F.col("_cand") & (nth % 2 == 1), F.col("_before")).otherwise(F.col("_v")))
    return rows.join(runs.select("session_id", "_island", F.col("_new").alias(output)), ["session_id", "_island"]).drop("_island")


# -- transitions -------------------------------------------------------------
def transition_count(df: DataFrame, room: str, window_s: int, output: str = "transitions") -> DataFrame:
    """Room changes between observed windows exactly one step apart. Sessions
    with no observed room report 0."""
    seen = df.filter(F.col(room).isNotNull()).select("session_id", "w", room)
    changed = (F.col(room) != F.lag(room).over(_session())) & _step(window_s)
    counts = seen.withColumn("_c", F.coalesce(changed, F.lit(False)).cast("int")).groupBy("session_id").agg(F.sum("_c").alias(output))
    return df.select("session_id").distinct().join(counts, "session_id", "left").na.fill(0, [output])


def transition_count_missing(df: DataFrame, room: str, keys: Sequence[str] = ("session_id",), output: str = "transitions") -> DataFrame:
    """Changes between consecutive rows where a missing room is a state of its own."""
    order = Window.partitionBy(*keys).orderBy("w")
    named = df.withColumn("_r", F.coalesce(F.col(room), F.lit("Missing")))
    changed = F.coalesce(F.col("_r") != F.lag("_r").over(order), F.lit(False))
    return named.withColumn("_c", changed.cast("int")).groupBy(*keys).agg(F.sum("_c").alias(output))


def transition_events(df: DataFrame, room: str, window_s: int, episodes: DataFrame | None = None) -> DataFrame:
    """Room-change rows with from/to, optionally only inside episodes (both the
    change and the window before it lie in the same episode)."""
    rows = df
    order = _session()
    if episodes is not None:
        inside = episodes.select("session_id", "episode_id", F.explode(bins("start", "end", window_s)).alias("w"))
        rows = df.join(inside, ["session_id", "w"])
        order = Window.partitionBy("session_id", "episode_id").orderBy("w")
    stepped = (F.unix_micros("w") - F.unix_micros(F.lag("w").over(order))) == window_s * 1_000_000
    marked = rows.withColumns({"from_room": F.lag(room).over(order), "_ok": stepped})
    return marked.filter(F.col("_ok") & (F.col("from_room") != F.col(room))).withColumn("to_room", F.col(room)).drop("_ok")


def room_transition_features(
    df: DataFrame, window_s: int, beacon: str = "beacon", floor: str = "floor", motion: str = "motion"
) -> DataFrame:
    """Beacon and floor changes between contiguous rows; a change is supported
    when a window before, at or after it shows motion."""
    near = F.max(F.coalesce(F.col(motion), F.lit(False))).over(_session().rowsBetween(-1, 1))
    out = df.withColumns(
        {
            "previous_beacon": F.lag(beacon).over(_session()),
            "previous_floor": F.lag(floor).over(_session()),
            "gap_before_minutes": minutes_between(F.lag("w").over(_session()), F.col("w")),
            "contiguous": F.coalesce(_step(window_s), F.lit(False)),
            "_near": near,
        }
    )
    changed = F.coalesce(F.col("contiguous") & (F.col(beacon) != F.col("previous_beacon")), F.lit(False))
    out = out.withColumn("room_transition", changed)
    other_floor = ~F.col(floor).eqNullSafe(F.col("previous_floor"))
    return out.withColumns(
        {
            "floor_transition": F.col("room_transition") & other_floor,
            "acc_supported": F.col("room_transition") & F.col("_near"),
            "unsupported": F.col("room_transition") & ~F.col("_near"),
            "support_rule": F.when(
                F.col("room_transition"),
                F.when(F.col("_near"), "awake ACC window within +/-5 min").otherwise("no awake ACC window within +/-5 min"),
            ),
        }
    ).drop("_near")


def floor_shift_support(
    df: DataFrame, window_s: int, floor: str = "floor", score: str = "acc_score", raw_max: str = "acc_max",
    spikes: str = "spike_count", min_score: float = 0.010,
) -> DataFrame:
    """Floor changes between contiguous windows with acceleration evidence of the
    rows one before to one after."""
    near = _session().rowsBetween(-1, 1)
    out = df.withColumns(
        {
            "previous_floor": F.lag(floor).over(_session()),
            "_step": _step(window_s),
            "support_start": F.min("w").over(near),
            "support_end": F.max("w").over(near),
            "max_score": F.max(score).over(near),
            "max_raw": F.max(raw_max).over(near),
            "total_spikes": F.sum(F.coalesce(F.col(spikes), F.lit(0))).over(near),
        }
    )
    supported = F.coalesce(F.col("max_score") >= min_score, F.lit(False)) | (F.col("total_spikes") > 0)
    return out.filter(F.col("_step") & (F.col(floor) != F.col("previous_floor"))).select(
        "session_id", F.col("w").alias("shift_time"), "previous_floor", F.col(floor).alias("current_floor"),
        "support_start", "support_end", "max_score", "max_raw", "total_spikes", supported.alias("supported"),
        F.when(supported, "acc_supported").otherwise("no_high_acc_in_shift_window").alias("support_reason"),
    )


# -- rolling over raw rows -------------------------------------------------
ROWS_PER_BUCKET = 100_000


def with_halo(
    df: DataFrame, radius: int, keys: Sequence[str] = ("session_id",), ts: str = "ts", ties: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET, chunk_seconds: int = 86_400,
) -> DataFrame:
    """Rows with their position ``_rn`` in session order, spread over buckets of
    ``rows_per_bucket`` positions (``_bucket``); rows within ``radius`` of an
    edge are copied to the neighbour with ``_own`` false. A window partitioned
    by (keys, _bucket) then sees every row a ±radius frame needs."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    numbered = Ordered(one, keys, ts, ties, chunk_seconds).running_sum(_rn="_one").done().drop("_one")
    width = max(rows_per_bucket, 2 * radius + 1)
    own = F.floor(F.col("_rn") / width).cast("bigint")
    low = F.floor((F.col("_rn") - radius) / width).cast("bigint")
    high = F.floor((F.col("_rn") + radius) / width).cast("bigint")
    copies = F.explode(F.array_distinct(F.array(low, own, high)))
    return numbered.select("*", copies.alias("_bucket")).withColumn("_own", F.col("_bucket") == own)


def rolling_median(
    df: DataFrame, value: str, output: str, window_rows: int, keys: Sequence[str] = ("session_id",), ts: str = "ts",
    ties: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Centred rolling median over ``window_rows`` rows, shrinking at the ends."""
    radius = window_rows // 2
    halo = with_halo(df, radius, keys, ts, ties, rows_per_bucket)
    frame = Window.partitionBy(*keys, "_bucket").orderBy("_rn").rowsBetween(-radius, radius)
    return halo.withColumn(output, F.percentile(value, F.lit(0.5)).over(frame)).filter("_own").drop("_bucket", "_own", "_rn")


# -- votes and look-back -------------------------------------------------------
def centred_vote(
    df: DataFrame, rssi: DataFrame, window_s: int, vote_s: int = 3600, low: str = "low_motion", beacon: str = "beacon",
) -> DataFrame:
    """Majority beacon over ``[t − half, t + half)`` within one observed segment
    for low-motion rows; count ties go to the higher mean signal over the
    candidate windows, a full tie keeps the raw beacon.

    ``df(session_id, w, segment_id, beacon, low_motion)``, segment NULL where
    nothing was observed; ``rssi(session_id, w, beacon, rssi_mean)``."""
    df, rssi = durable(df), durable(rssi)  # targets, candidates and signal lookups
    half = vote_s // 2
    reach = [i * window_s for i in range(-(half // window_s) + 1, half // window_s + 1)]
    keys = ["session_id", "segment_id", "t"]
    seen = df.filter(F.col("segment_id").isNotNull())
    # a candidate at w votes for every t with t − half <= w < t + half
    votes = seen.select(
        "session_id", "segment_id", F.col("w").alias("cw"), F.col(beacon).alias("vote"),
        F.explode(F.array(*[F.lit(s) for s in reach])).alias("_off"),
    ).withColumn("t", shift_ts("cw", F.col("_off"))).drop("_off")
    targets = seen.filter(F.coalesce(F.col(low), F.lit(False))).select("session_id", "segment_id", F.col("w").alias("t"), F.col(beacon).alias("raw"))
    cast = votes.join(targets, keys)
    counts = cast.groupBy(*keys, "raw", "vote").agg(F.count("*").alias("n"))
    per_target = Window.partitionBy(*keys)
    counts = counts.withColumns({"_top": F.max("n").over(per_target), "_all": F.sum("n").over(per_target)})
    tied = counts.filter("n = _top").withColumn("_ties", F.count("*").over(per_target))
    # signal of tied beacons, only where there is a tie
    scored = (
        cast.select(*keys, "cw")
        .join(tied.filter("_ties > 1").select(*keys, "vote"), keys)
        .join(rssi.select("session_id", F.col("w").alias("cw"), F.col("beacon").alias("vote"), "rssi_mean"), ["session_id", "cw", "vote"])
        .groupBy(*keys, "vote")
        .agg(F.round(F.avg("rssi_mean"), 9).alias("_score"))
    )
    ranked = tied.join(scored, [*keys, "vote"], "left")
    best = ranked.withColumn("_best", F.max("_score").over(per_target))
    winners = best.filter((F.col("_ties") == 1) | F.col("_score").eqNullSafe(F.col("_best"))).groupBy(*keys).agg(
        F.min("vote").alias("_w"), F.count("*").alias("_nw"), F.first("raw").alias("_raw"),
        F.first("_top").alias("vote_count"), F.first("_all").alias("window_count"), F.first("_ties").alias("_ties"),
    )
    minutes = vote_s // 60
    winner = F.when(F.col("_nw") == 1, F.col("_w")).otherwise(F.col("_raw"))
    reason = (
        F.when(F.col("_ties") == 1, f"low_motion_{minutes}min_majority")
        .when(F.col("_nw") == 1, f"low_motion_{minutes}min_vote_tie_rssi")
        .otherwise(f"low_motion_{minutes}min_full_tie_fallback_raw")
    )
    result = winners.select(
        "session_id", F.col("t").alias("w"), winner.alias("_win"), "vote_count", "window_count",
        (F.col("vote_count") / F.col("window_count")).alias("dominant_share"), reason.alias("_reason"),
    )
    kept = F.when(F.col("segment_id").isNull(), "missing_rssi").otherwise("high_motion_keep_raw")
    return (
        df.join(result, ["session_id", "w"], "left")
        .withColumn("corrected_beacon", F.coalesce("_win", F.col(beacon)))
        .withColumn("correction_reason", F.coalesce("_reason", kept))
        .withColumn("was_corrected", F.coalesce(F.col("_win") != F.col(beacon), F.lit(False)))
        .na.fill(0, ["vote_count", "window_count"])
        .drop("_win", "_reason")
    )


def adaptive_awake_rssi(timeline: DataFrame, rssi: DataFrame, lookback: dict[int, Sequence[int]], window_s: int = 300) -> DataFrame:
    """Awake observed rows: mean signal per beacon over the look-back of the
    row's movement state, cut after the last reset; strongest beacon wins.

    Resets: a time gap, missing signal, main sleep, not observed indoors, a
    higher or unknown movement state, another trusted floor group. ``lookback``
    maps the number of states to minutes per state. Returns (session_id, w,
    adaptive_beacon, adaptive_window_minutes) for rows that get a result."""
    timeline = durable(timeline)
    minutes = F.lit(None).cast("int")
    for k, per_state in lookback.items():
        for state, m in enumerate(per_state, start=1):
            minutes = F.when((F.col("movement_k") == k) & (F.col("movement_state") == state), F.lit(m)).otherwise(minutes)
    cols = ["session_id", "w", "rssi_observed", "main_sleep", "occupancy_state", "movement_state"]
    has_floor = "pressure_floor_group" in timeline.columns
    if has_floor:
        cols.append("pressure_floor_group")
    t = timeline.select(*cols, minutes.alias("_minutes"))
    target = t.filter(
        ~F.col("main_sleep") & (F.col("occupancy_state") == "indoor_observed") & F.col("rssi_observed") & F.col("_minutes").isNotNull()
    )
    slots = F.sequence(F.lit(0), (F.col("_minutes") * 60 / window_s).cast("int") - 1)
    looked = target.select(
        "session_id", F.col("w").alias("t"), F.col("movement_state").alias("_state"), "_minutes",
        *([F.col("pressure_floor_group").alias("_floor")] if has_floor else []), F.explode(slots).alias("slot"),
    ).withColumn("w", shift_ts("t", -F.col("slot") * window_s))
    row = t.drop("_minutes").withColumn("_present", F.lit(True))
    seen = looked.join(row, ["session_id", "w"], "left")
    reset = (
        ~F.col("rssi_observed")
        | F.col("main_sleep")
        | (F.col("occupancy_state") != "indoor_observed")
        | F.col("movement_state").isNull()
        | (F.col("movement_state") > F.col("_state"))
    )
    if has_floor:
        reset = reset | F.coalesce(F.col("pressure_floor_group") != F.col("_floor"), F.lit(False))
    per_target = Window.partitionBy("session_id", "t")
    oldest = F.max(F.when(F.col("_present"), F.col("slot"))).over(per_target)
    back = per_target.orderBy("slot")
    after_gap = F.lead("_present").over(back).isNull() & F.col("_present") & (F.col("slot") < oldest)
    seen = seen.filter("slot is not null").withColumn("_reset", F.coalesce(F.col("_present") & (reset | after_gap), F.lit(False)))
    first_reset = F.min(F.when(F.col("_reset"), F.col("slot"))).over(per_target)
    kept = seen.withColumn("_cut", first_reset).filter(F.col("_present") & (F.col("_cut").isNull() | (F.col("slot") < F.col("_cut"))))
    means = (
        kept.select("session_id", "t", "w", "_minutes")
        .join(rssi.filter("rssi_mean is not null").select("session_id", "w", "beacon", "rssi_mean"), ["session_id", "w"])
        .groupBy("session_id", "t", "_minutes", "beacon")
        .agg(F.avg("rssi_mean").alias("m"))
    )
    return (
        means.groupBy("session_id", "t", "_minutes")
        .agg(F.min_by("beacon", F.struct((-F.round("m", 9)).alias("a"), F.col("beacon").alias("b"))).alias("adaptive_beacon"))
        .select("session_id", F.col("t").alias("w"), "adaptive_beacon", F.col("_minutes").alias("adaptive_window_minutes"))
    )


def episode_dominant(df: DataFrame, episodes: DataFrame, window_s: int, label: str) -> DataFrame:
    """Most frequent non-null label of each episode with count and share."""
    inside = episodes.select("session_id", "episode_id", F.explode(bins("start", "end", window_s)).alias("w"))
    return mode_label(df.join(inside, ["session_id", "w"]), ["session_id", "episode_id"], label)


def transition_summary(features: DataFrame, window_s: int, keys: Sequence[str] = ("session_id",), motion: str = "motion") -> DataFrame:
    """Totals and rates per observed and per awake hour (0 where no time)."""
    hours = window_s / 3600.0
    n = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("bigint"))
    out = features.groupBy(*keys).agg(
        F.count("*").alias("observed_windows"), n(motion).alias("awake_windows"), n("room_transition").alias("transitions"),
        n("acc_supported").alias("supported"), n("unsupported").alias("unsupported"), n("floor_transition").alias("floor_switches"),
    )
    out = out.withColumns({"observed_hours": F.col("observed_windows") * hours, "awake_hours": F.col("awake_windows") * hours})

    def rate(count: str, per: str) -> Column:
        return F.when(F.col(per) > 0, F.col(count) / F.col(per)).otherwise(F.lit(0.0))

    return out.withColumns(
        {
            "supported_fraction": rate("supported", "transitions"),
            "per_observed_hour": rate("transitions", "observed_hours"),
            "per_awake_hour": rate("transitions", "awake_hours"),
            "supported_per_awake_hour": rate("supported", "awake_hours"),
            "unsupported_per_awake_hour": rate("unsupported", "awake_hours"),
        }
    )
