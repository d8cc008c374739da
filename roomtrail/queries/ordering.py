"""Top-k, mode, runs, transitions, votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import timefn
from ..operators import byvalue, runs, topk
from ..operators import windows as win
from ..params import LOOKBACK_MINUTES
from ..registry import query
from .ctes import cte, with_ctes

HOUR = 3600
Q = 900  # timeline windows of the queries: 15 minutes

cte(
    tlw="""SELECT session_id, time_bucket(INTERVAL 15 MINUTE, ts) AS w, round(avg(value), 6) AS av, count(*) AS n, max(value) AS mx,
      sum(CAST(value > 200 AS INT)) AS spikes FROM ev GROUP BY 1, 2""",
    tlrs="""SELECT session_id, time_bucket(INTERVAL 15 MINUTE, ts) AS w, event_type AS beacon, avg(-(40 + value % 50)) AS rssi_mean, count(*) AS rssi_cnt
      FROM ev WHERE event_type <> 'error' GROUP BY 1, 2, 3""",
    tlr="""SELECT session_id, w, beacon FROM (SELECT *, row_number() OVER (PARTITION BY session_id, w ORDER BY rssi_mean DESC, beacon) AS r FROM tlrs) WHERE r = 1""",
    tl="""SELECT g.session_id, g.w, r.beacon, b.room, b.floor, r.beacon IS NOT NULL AS observed, a.av, coalesce(a.av <= 50, false) AS low_motion,
      coalesce(a.spikes, 0) AS spikes, a.mx, a.n, coalesce(a.av > 60, false) AS motion
      FROM (SELECT session_id, unnest(generate_series(min(w), max(w), INTERVAL 15 MINUTE)) AS w FROM tlw GROUP BY 1) g
      LEFT JOIN tlw a ON a.session_id = g.session_id AND a.w = g.w LEFT JOIN tlr r ON r.session_id = g.session_id AND r.w = g.w
      LEFT JOIN beacons b ON b.beacon = r.beacon""",
)


def timeline_rssi(spark, sf):
    """Signal per (window, beacon); a scan that failed ('error') carries none."""
    level = F.when(F.col("beacon") != "error", F.col("rssi"))
    return win.rssi_window_agg(A.rssi_samples(spark, sf).withColumn("rssi", level), Q)


def timeline(spark, sf):
    """15-minute grid: strongest beacon, room, floor, motion evidence."""
    ev = A.events(spark, sf).withColumn("w", timefn.floor_ts("ts", Q))
    per = ev.groupBy("session_id", "w").agg(
        F.round(F.avg("value"), 6).alias("av"), F.count("*").alias("n"), F.max("value").alias("mx"),
        F.sum((F.col("value") > 200).cast("int")).alias("spikes"),
    )
    strong = topk.strongest_beacon(timeline_rssi(spark, sf)).select("session_id", "w", F.col("strongest_beacon").alias("beacon"))
    grid = win.window_grid(per, Q)
    out = grid.join(per, ["session_id", "w"], "left").join(strong, ["session_id", "w"], "left")
    out = out.join(F.broadcast(A.beacons(spark)), "beacon", "left")
    return out.withColumns(
        {
            "observed": F.col("beacon").isNotNull(),
            "low_motion": F.coalesce(F.col("av") <= 50, F.lit(False)),
            "motion": F.coalesce(F.col("av") > 60, F.lit(False)),
            "spikes": F.coalesce("spikes", F.lit(0)),
        }
    )


# -- top-k -------------------------------------------------------------------
@query(
    "strongest_beacon",
    "session_id:i w:t strongest_beacon:s strongest_rssi:f second_rssi:f gap_db:f rssi_sample_count:i rssi_available_beacons:i rssi_observed:b room:s",
    with_ctes("""SELECT r.session_id, r.w, CASE WHEN n > 0 THEN a END AS strongest_beacon, m1 AS strongest_rssi, m2 AS second_rssi, m1 - m2 AS gap_db,
       c AS rssi_sample_count, n AS rssi_available_beacons, n > 0 AS rssi_observed, CASE WHEN n > 0 THEN coalesce(room, 'Unknown') END AS room FROM (
      SELECT session_id, w, max(CASE WHEN k = 1 THEN beacon END) AS a, max(CASE WHEN k = 1 THEN rssi_mean END) AS m1, max(CASE WHEN k = 2 THEN rssi_mean END) AS m2,
       sum(rssi_cnt) AS c, count(rssi_mean) AS n FROM (SELECT *, row_number() OVER (PARTITION BY session_id, w ORDER BY rssi_mean DESC NULLS LAST, beacon) AS k FROM rq)
      GROUP BY 1, 2) r LEFT JOIN beacons ON a = beacon"""),
)
def _(spark, sf):
    w = win.rssi_quality_filter(win.rssi_window_agg(A.rssi_samples(spark, sf), HOUR))
    return topk.strongest_beacon(w, A.beacons(spark))


@query(
    "strongest_per_sample",
    "session_id:i w:t beacon:s wins:i share:f dominance:f",
    with_ctes("SELECT *, max(share) OVER (PARTITION BY session_id, w) AS dominance FROM wins"),
)
def _(spark, sf):
    return topk.strongest_share(A.rssi_samples(spark, sf), HOUR)


@query(
    "weakest_beacon_diagnostic",
    "session_id:i w:t max_beacon:s min_beacon:s prop_max_beacon:s prop_max_fraction:f prop_min_beacon:s prop_min_fraction:f",
    with_ctes("""SELECT session_id, w, max_beacon, min_beacon, prop_max_beacon, prop_max_fraction, prop_min_beacon, prop_min_fraction FROM
      (SELECT session_id, w, arg_min(beacon, (-rssi_mean, beacon)) AS max_beacon, arg_min(beacon, (rssi_mean, beacon)) AS min_beacon FROM rw GROUP BY 1, 2)
      JOIN (SELECT session_id, w, arg_min(beacon, (-wins, beacon)) AS prop_max_beacon, max(share) AS prop_max_fraction FROM wins GROUP BY 1, 2) USING (session_id, w)
      JOIN (SELECT session_id, w, arg_min(beacon, (-c, beacon)) AS prop_min_beacon, max(c) / sum(c) AS prop_min_fraction FROM (
        SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, beacon, count(*) AS c FROM (SELECT session_id, ts, beacon,
          row_number() OVER (PARTITION BY session_id, ts ORDER BY rssi, beacon) AS r FROM (SELECT session_id, ts, beacon, avg(rssi) AS rssi FROM rssi GROUP BY 1, 2, 3))
        WHERE r = 1 GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (session_id, w)"""),
)
def _(spark, sf):
    samples = A.rssi_samples(spark, sf)
    return topk.weakest_beacon_diagnostic(samples, HOUR)


@query(
    "mode_label",
    "session_id:i w:t label:s n:i total:i",
    with_ctes("""SELECT session_id, w, label, n, total FROM (SELECT *, row_number() OVER (PARTITION BY session_id, w ORDER BY n DESC, label) AS r,
      sum(n) OVER (PARTITION BY session_id, w) AS total FROM (SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type AS label, count(*) AS n
      FROM ev GROUP BY 1, 2, 3)) WHERE r = 1"""),
)
def _(spark, sf):
    ev = A.events(spark, sf).select("session_id", timefn.floor_ts("ts", HOUR).alias("w"), F.col("event_type").alias("label"))
    return topk.mode_label(ev, ["session_id", "w"], "label")


@query(
    "interval_mode",
    "session_id:i event_id:i room:s samples:i best_gap:f",
    with_ctes("""SELECT session_id, event_id, coalesce(arg_min(room, (-c, room)), 'Out') AS room, coalesce(sum(c), 0) AS samples, arg_min({'g': g}, (-c, room)).g AS best_gap FROM (
       SELECT i.session_id, i.event_id, t.room, sum(t.rssi_sample_count) AS c, arg_max({'g': t.gap_db}, (t.rssi_sample_count, -epoch_us(t.w))).g AS g FROM ivl2 i
       LEFT JOIN (SELECT r.session_id, r.w, b.room, rssi_sample_count, gap_db FROM rtop r JOIN beacons b ON b.beacon = r.strongest_beacon) t
         ON t.session_id = i.session_id AND t.w >= i."start" AND t.w < i."end" GROUP BY 1, 2, 3) GROUP BY 1, 2""",
      ivl2="""SELECT session_id, event_id, "start", "start" + INTERVAL 150 MINUTE AS "end" FROM ivl"""),
)
def _(spark, sf):
    iv = A.intervals(spark, sf).withColumn("end", timefn.shift_ts("start", 150 * 60))
    top = topk.strongest_beacon(win.rssi_window_agg(A.rssi_samples(spark, sf), HOUR), A.beacons(spark))
    return topk.interval_mode(iv, top, HOUR)


cte(
    pdiff="""SELECT w.session_id, w.w, wearable_hpa, sensor, beacon_hpa, wearable_hpa - beacon_hpa AS diff, abs(wearable_hpa - beacon_hpa) AS abs_diff FROM
      (SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, quantile_cont(hpa, 0.5) AS wearable_hpa FROM press WHERE sensor = 'error' GROUP BY 1, 2) w
      JOIN (SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, sensor, quantile_cont(hpa, 0.5) AS beacon_hpa FROM press WHERE sensor <> 'error' GROUP BY 1, 2, 3) b
      USING (session_id, w)""",
)


def pressure_split(spark, sf):
    """Wearable samples ('error' rows) and environmental beacon samples."""
    p = A.pressure_samples(spark, sf)
    return p.filter("sensor = 'error'"), p.filter("sensor <> 'error'")


@query(
    "nearest_pressure_beacon",
    "session_id:i w:t wearable_hpa:f closest_beacon:s closest_abs_diff:f second_abs_diff:f closest_margin:f",
    with_ctes("""SELECT session_id, w, wearable_hpa, max(CASE WHEN r = 1 THEN sensor END) AS closest_beacon, max(CASE WHEN r = 1 THEN abs_diff END) AS closest_abs_diff,
      max(CASE WHEN r = 2 THEN abs_diff END) AS second_abs_diff, max(CASE WHEN r = 2 THEN abs_diff END) - max(CASE WHEN r = 1 THEN abs_diff END) AS closest_margin
      FROM (SELECT *, row_number() OVER (PARTITION BY session_id, w ORDER BY abs_diff, sensor) AS r FROM pdiff) GROUP BY 1, 2, 3"""),
)
def _(spark, sf):
    return topk.nearest_pressure_beacon(*pressure_split(spark, sf), HOUR)


# -- runs ----------------------------------------------------------------------
@query(
    "boolean_runs",
    "session_id:i run_id:i start:t end:t windows:i duration_minutes:f",
    with_ctes("""SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY "start") AS run_id, * EXCLUDE (session_id, isl), windows * 15.0 AS duration_minutes FROM (
      SELECT session_id, isl, min(w) AS "start", max(w) + INTERVAL 15 MINUTE AS "end", count(*) AS windows FROM (
       SELECT *, w - INTERVAL 15 MINUTE * row_number() OVER (PARTITION BY session_id ORDER BY w) AS isl FROM tl WHERE NOT observed) GROUP BY 1, 2)"""),
)
def _(spark, sf):
    return runs.boolean_runs(timeline(spark, sf).withColumn("missing", ~F.col("observed")), "missing", Q)


@query(
    "state_runs",
    "session_id:i run_id:i room:s start:t end:t windows:i duration_minutes:f",
    with_ctes("""SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY "start") AS run_id, room, "start", "end", windows, windows * 15.0 AS duration_minutes FROM (
      SELECT session_id, room, min(w) AS "start", max(w) + INTERVAL 15 MINUTE AS "end", count(*) AS windows FROM (
       SELECT *, w - INTERVAL 15 MINUTE * row_number() OVER (PARTITION BY session_id, room ORDER BY w) AS isl FROM tl WHERE room IS NOT NULL) GROUP BY session_id, room, isl)"""),
)
def _(spark, sf):
    return runs.state_runs(timeline(spark, sf), "room", Q)


cte(
    seg="""SELECT session_id, w, sum(CASE WHEN p IS NULL OR w - p <> INTERVAL 15 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY w) AS segment_id
      FROM (SELECT session_id, w, lag(w) OVER (PARTITION BY session_id ORDER BY w) AS p FROM tl WHERE observed)""",
    bouts="""SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY "start") AS candidate_id, "start", "end", duration_minutes, low_motion_share FROM (
      SELECT b.session_id, b."start", b."end", date_diff('minute', b."start", b."end") AS duration_minutes, sum(CAST(t.low_motion AS INT)) / count(*) AS low_motion_share
      FROM (SELECT session_id, min(w) AS "start", max(w) + INTERVAL 15 MINUTE AS "end" FROM (
         SELECT session_id, w, sum(CASE WHEN p IS NULL OR w - p > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY w) AS g FROM (
          SELECT session_id, w, lag(w) OVER (PARTITION BY session_id ORDER BY w) AS p FROM tl WHERE low_motion)) GROUP BY session_id, g) b
      JOIN tl t ON t.session_id = b.session_id AND t.w >= b."start" AND t.w < b."end" GROUP BY 1, 2, 3) WHERE duration_minutes >= 60 AND low_motion_share >= 0.6""",
    nights="""SELECT * FROM (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY "start") AS episode_id, * EXCLUDE (session_id), windows * 15.0 AS duration_minutes FROM (
       SELECT session_id, night, min(w) AS "start", max(w) + INTERVAL 15 MINUTE AS "end", count(*) AS windows FROM (
       SELECT *, w - INTERVAL 15 MINUTE * row_number() OVER (PARTITION BY session_id, night ORDER BY w) AS isl FROM (
        SELECT *, CASE WHEN hour(w) >= 18 THEN CAST(w AS DATE) ELSE CAST(w AS DATE) - 1 END AS night FROM tl
        WHERE low_motion AND beacon IS NOT NULL AND (hour(w) >= 18 OR hour(w) < 10))) GROUP BY session_id, night, isl)) WHERE duration_minutes >= 45""",
)


@query(
    "observed_segments", "session_id:i w:t segment_id:i",
    with_ctes("SELECT tl.session_id, tl.w, segment_id FROM tl LEFT JOIN seg USING (session_id, w)"),
)
def _(spark, sf):
    return runs.observed_segments(timeline(spark, sf), "observed", Q)


@query("bridged_bouts", "session_id:i candidate_id:i start:t end:t duration_minutes:f low_motion_share:f", with_ctes("SELECT * FROM bouts"))
def _(spark, sf):
    return runs.bridged_bouts(timeline(spark, sf), "low_motion", Q, 900)


@query("night_runs", "session_id:i episode_id:i night:d start:t end:t windows:i duration_minutes:f", with_ctes("SELECT * FROM nights"))
def _(spark, sf):
    return runs.night_runs(timeline(spark, sf), "low_motion", Q, 18, 10, 45, split_nights=True, beacon="beacon")


cte(
    flseg="""SELECT session_id, isl, any_value(floor) AS floor, min(w) AS "start", max(w) AS "end", count(*) AS windows, quantile_cont(av, 0.5) AS median_av FROM (
      SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY w) AS isl FROM (
       SELECT *, CASE WHEN floor IS NOT DISTINCT FROM lag(floor) OVER (PARTITION BY session_id ORDER BY w) AND row_number() OVER (PARTITION BY session_id ORDER BY w) > 1
         THEN 0 ELSE 1 END AS c FROM tl)) GROUP BY 1, 2""",
)


@query(
    "floor_segments", "session_id:i floor:s start:t end:t windows:i median_av:g duration_minutes:f",
    with_ctes("SELECT *, windows * 15.0 AS duration_minutes FROM flseg WHERE floor IS NOT NULL"),
)
def _(spark, sf):
    return runs.floor_segments(timeline(spark, sf), "floor", Q, ["av"])


# left-to-right smoothing as a recursive walk over the runs: the sequential definition
@query(
    "smooth_short_runs", "session_id:i w:t floor:s smoothed:s",
    with_ctes("""SELECT t.session_id, t.w, t.floor, s.v AS smoothed FROM tl t JOIN flseg f ON t.session_id = f.session_id AND t.w BETWEEN f."start" AND f."end"
      JOIN walk s ON s.session_id = f.session_id AND s.isl = f.isl""",
      nxt="SELECT *, lead(floor) OVER (PARTITION BY session_id ORDER BY isl) AS after FROM flseg",
      walk="""WITH RECURSIVE r AS (
        SELECT session_id, isl, floor AS v FROM nxt WHERE isl = 1
        UNION ALL SELECT n.session_id, n.isl, CASE WHEN n.windows <= 2 AND n.floor IS NOT NULL AND r.v = n.after AND r.v <> n.floor THEN r.v ELSE n.floor END
        FROM r JOIN nxt n ON n.session_id = r.session_id AND n.isl = r.isl + 1) SELECT * FROM r"""),
)
def _(spark, sf):
    return runs.smooth_short_runs(timeline(spark, sf), "floor", "smoothed")


# -- transitions -------------------------------------------------------------
@query(
    "transition_count", "session_id:i transitions:i",
    with_ctes("""SELECT session_id, sum(CASE WHEN room <> pr AND w - pw = INTERVAL 15 MINUTE THEN 1 ELSE 0 END) AS transitions FROM (SELECT session_id, w, room,
      lag(room) OVER o AS pr, lag(w) OVER o AS pw FROM tl WHERE room IS NOT NULL WINDOW o AS (PARTITION BY session_id ORDER BY w)) GROUP BY 1"""),
)
def _(spark, sf):
    return runs.transition_count(timeline(spark, sf), "room", Q)


@query(
    "transition_count_missing", "session_id:i transitions:i",
    with_ctes("""SELECT session_id, sum(CASE WHEN r <> pr THEN 1 ELSE 0 END) AS transitions FROM (SELECT session_id, r, lag(r) OVER (PARTITION BY session_id ORDER BY w) AS pr
      FROM (SELECT session_id, w, coalesce(room, 'Missing') AS r FROM tl)) GROUP BY 1"""),
)
def _(spark, sf):
    return runs.transition_count_missing(timeline(spark, sf), "room")


@query(
    "room_per_window", "session_id:i room:s windows:i transitions:i",
    with_ctes("""SELECT t.session_id, t.room, count(*) AS windows, any_value(c.transitions) AS transitions FROM top t JOIN (
        SELECT session_id, sum(CASE WHEN room <> pr AND w - pw = INTERVAL 1 HOUR THEN 1 ELSE 0 END) AS transitions FROM (SELECT session_id, w, room,
        lag(room) OVER o AS pr, lag(w) OVER o AS pw FROM top WINDOW o AS (PARTITION BY session_id ORDER BY w)) GROUP BY 1) c USING (session_id) GROUP BY 1, 2""",
      top="""SELECT session_id, w, room FROM (SELECT *, row_number() OVER (PARTITION BY session_id, w ORDER BY rssi_mean DESC, beacon) AS r FROM rq WHERE rssi_mean IS NOT NULL)
        JOIN beacons USING (beacon) WHERE r = 1"""),
)
def _(spark, sf):
    w = win.rssi_quality_filter(win.rssi_window_agg(A.rssi_samples(spark, sf), HOUR))
    top = topk.strongest_beacon(w, A.beacons(spark))
    moves = runs.transition_count(top, "room", HOUR)
    return top.filter("room is not null").groupBy("session_id", "room").agg(F.count("*").alias("windows")).join(moves, "session_id")


@query(
    "transition_events", "session_id:i episode_id:i w:t from_room:s to_room:s av:f low_motion:b",
    with_ctes("""SELECT session_id, episode_id, w, pr AS from_room, room AS to_room, av, low_motion FROM (SELECT t.session_id, b.candidate_id AS episode_id, t.w, t.room, t.av, t.low_motion,
       lag(t.room) OVER o AS pr, lag(t.w) OVER o AS pw FROM tl t JOIN bouts b ON t.session_id = b.session_id AND t.w >= b."start" AND t.w < b."end"
       WINDOW o AS (PARTITION BY t.session_id, b.candidate_id ORDER BY t.w)) WHERE room <> pr AND w - pw = INTERVAL 15 MINUTE"""),
)
def _(spark, sf):
    t = timeline(spark, sf)
    ep = runs.bridged_bouts(t, "low_motion", Q, 900).withColumnRenamed("candidate_id", "episode_id")
    return runs.transition_events(t, "room", Q, ep)


cte(
    otl="""SELECT * FROM tl WHERE n IS NOT NULL""",
    rtf="""SELECT *, gap_before_minutes = 15 AND coalesce(beacon <> pb, false) AS room_transition,
       gap_before_minutes = 15 AND coalesce(beacon <> pb, false) AND floor IS DISTINCT FROM pf AS floor_transition FROM (
      SELECT *, lag(beacon) OVER o AS pb, lag(floor) OVER o AS pf, date_diff('minute', lag(w) OVER o, w) AS gap_before_minutes,
       bool_or(motion) OVER (PARTITION BY session_id ORDER BY w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near
       FROM otl WINDOW o AS (PARTITION BY session_id ORDER BY w))""",
)


def observed_timeline(spark, sf):
    """Only windows with any sample: rows may be further apart than one step."""
    return timeline(spark, sf).filter("n is not null")


@query(
    "room_transition_features",
    "session_id:i w:t previous_beacon:s gap_before_minutes:f contiguous:b room_transition:b floor_transition:b acc_supported:b unsupported:b support_rule:s",
    with_ctes("""SELECT session_id, w, pb AS previous_beacon, gap_before_minutes, coalesce(gap_before_minutes = 15, false) AS contiguous, coalesce(room_transition, false) AS room_transition,
      coalesce(floor_transition, false) AS floor_transition, coalesce(room_transition AND near, false) AS acc_supported, coalesce(room_transition AND NOT near, false) AS unsupported,
      CASE WHEN room_transition AND near THEN 'awake ACC window within +/-5 min' WHEN room_transition THEN 'no awake ACC window within +/-5 min' END AS support_rule FROM rtf"""),
)
def _(spark, sf):
    return runs.room_transition_features(observed_timeline(spark, sf), Q)


cte(
    shifts="""SELECT session_id, w AS shift_time, pf AS previous_floor, floor AS current_floor, support_start, support_end, max_score, max_raw, total_spikes,
       coalesce(max_score >= 60, false) OR total_spikes > 0 AS supported FROM (
      SELECT *, lag(floor) OVER o AS pf, lag(w) OVER o AS pw, min(w) OVER a AS support_start, max(w) OVER a AS support_end, max(av) OVER a AS max_score, max(mx) OVER a AS max_raw,
       sum(spikes) OVER a AS total_spikes FROM otl WINDOW o AS (PARTITION BY session_id ORDER BY w),
       a AS (PARTITION BY session_id ORDER BY w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) WHERE floor <> pf AND w - pw = INTERVAL 15 MINUTE""",
)


def floor_shifts(spark, sf):
    return runs.floor_shift_support(observed_timeline(spark, sf), Q, score="av", raw_max="mx", spikes="spikes", min_score=60)


@query(
    "floor_shift_support",
    "session_id:i shift_time:t previous_floor:s current_floor:s support_start:t support_end:t max_score:f max_raw:f total_spikes:i supported:b support_reason:s",
    with_ctes("SELECT *, CASE WHEN supported THEN 'acc_supported' ELSE 'no_high_acc_in_shift_window' END AS support_reason FROM shifts"),
)
def _(spark, sf):
    return floor_shifts(spark, sf)


@query(
    "rolling_median", "session_id:i sensor:s event_id:i hpa:f m3:f m7:f",
    with_ctes("""SELECT session_id, sensor, event_id, hpa,
      quantile_cont(hpa, 0.5) OVER (PARTITION BY session_id, sensor ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m3,
      quantile_cont(hpa, 0.5) OVER (PARTITION BY session_id, sensor ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m7 FROM press"""),
)
def _(spark, sf):
    p = A.pressure_samples(spark, sf)
    keys = ("session_id", "sensor")
    once = runs.rolling_median(p, "hpa", "m3", 3, keys, ties=["event_id"])
    return runs.rolling_median(once, "hpa", "m7", 7, keys, ties=["event_id"])


@query(
    "centred_vote",
    "session_id:i w:t beacon:s corrected_beacon:s vote_count:i window_count:i dominant_share:f correction_reason:s was_corrected:b",
    with_ctes("""SELECT t.session_id, t.w, t.beacon, coalesce(v.win, t.beacon) AS corrected_beacon, coalesce(v.vc, 0) AS vote_count, coalesce(v.wc, 0) AS window_count, v.vc / v.wc AS dominant_share,
      coalesce(v.reason, CASE WHEN s.segment_id IS NULL THEN 'missing_rssi' ELSE 'high_motion_keep_raw' END) AS correction_reason, coalesce(v.win <> t.beacon, false) AS was_corrected
      FROM tl t LEFT JOIN seg s USING (session_id, w) LEFT JOIN res v USING (session_id, w)""",
      cand="""SELECT t.session_id, t.w, t.beacon AS raw, c.w AS cw, c.beacon AS vote FROM (SELECT * FROM tl JOIN seg USING (session_id, w)) t
        JOIN (SELECT * FROM tl JOIN seg USING (session_id, w)) c ON c.session_id = t.session_id AND c.segment_id = t.segment_id
         AND c.w >= t.w - INTERVAL 60 MINUTE AND c.w < t.w + INTERVAL 60 MINUTE WHERE t.low_motion""",
      cnt="SELECT *, max(n) OVER (PARTITION BY session_id, w) AS top, sum(n) OVER (PARTITION BY session_id, w) AS wc FROM (SELECT session_id, w, raw, vote, count(*) AS n FROM cand GROUP BY ALL)",
      sc="""SELECT c.session_id, c.w, c.raw, c.vote, c.top, c.wc, count(*) OVER (PARTITION BY c.session_id, c.w) AS ties, (SELECT round(avg(r.rssi_mean), 9) FROM cand k JOIN tlrs r
          ON r.session_id = k.session_id AND r.w = k.cw AND r.beacon = c.vote WHERE k.session_id = c.session_id AND k.w = c.w) AS score FROM cnt c WHERE n = top""",
      res="""SELECT session_id, w, any_value(top) AS vc, any_value(wc) AS wc, CASE WHEN count(*) = 1 THEN min(vote) ELSE any_value(raw) END AS win,
        CASE WHEN any_value(ties) = 1 THEN 'low_motion_120min_majority' WHEN count(*) = 1 THEN 'low_motion_120min_vote_tie_rssi' ELSE 'low_motion_120min_full_tie_fallback_raw' END AS reason
        FROM (SELECT *, max(score) OVER (PARTITION BY session_id, w) AS best FROM sc) WHERE ties = 1 OR score IS NOT DISTINCT FROM best GROUP BY 1, 2"""),
)
def _(spark, sf):
    t = runs.observed_segments(timeline(spark, sf), "observed", Q)
    return runs.centred_vote(t, timeline_rssi(spark, sf), Q, 7200)


# movement states by mean value: three states, look-back 30/10/5 windows-minutes scaled by three
cte(
    mtl="""SELECT *, CASE WHEN av IS NULL THEN NULL WHEN av <= 50 THEN 1 WHEN av <= 90 THEN 2 ELSE 3 END AS movement_state, coalesce(av <= 15, false) AS main_sleep,
      CASE WHEN observed THEN 'indoor_observed' ELSE 'unknown' END AS occupancy_state FROM tl""",
)


def state_timeline(spark, sf):
    t = timeline(spark, sf)
    state = F.when(F.col("av") <= 50, 1).when(F.col("av") <= 90, 2).when(F.col("av").isNotNull(), 3)
    return t.withColumns(
        {
            "movement_state": state,
            "movement_k": F.lit(3),
            "main_sleep": F.coalesce(F.col("av") <= 15, F.lit(False)),
            "rssi_observed": F.col("observed"),
            "occupancy_state": F.when(F.col("observed"), "indoor_observed").otherwise("unknown"),
        }
    )


@query(
    "adaptive_awake_rssi", "session_id:i w:t adaptive_beacon:s adaptive_window_minutes:i",
    with_ctes("""SELECT session_id, w, beacon AS adaptive_beacon, m AS adaptive_window_minutes FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id, w ORDER BY s DESC, beacon) AS r FROM (
       SELECT k.session_id, k.t AS w, k.m, q.beacon, round(avg(q.rssi_mean), 9) AS s FROM kept k JOIN tlrs q ON q.session_id = k.session_id AND q.w = k.w GROUP BY 1, 2, 3, 4)) WHERE r = 1""",
      tgt="""SELECT *, CASE movement_state WHEN 1 THEN 90 WHEN 2 THEN 30 ELSE 15 END AS m FROM mtl WHERE NOT main_sleep AND observed AND movement_state IS NOT NULL""",
      look="""SELECT a.session_id, a.w AS t, a.m, b.w, NOT b.observed OR b.main_sleep OR b.movement_state IS NULL OR b.movement_state > a.movement_state AS reset
        FROM tgt a JOIN mtl b ON b.session_id = a.session_id AND b.w <= a.w AND b.w > a.w - INTERVAL 1 MINUTE * a.m""",
      kept="""SELECT * FROM (SELECT *, max(CASE WHEN reset THEN w END) OVER (PARTITION BY session_id, t) AS lr FROM look) WHERE lr IS NULL OR w > lr"""),
)
def _(spark, sf):
    scaled = {k: [m * 3 for m in v] for k, v in LOOKBACK_MINUTES.items()}
    return runs.adaptive_awake_rssi(state_timeline(spark, sf), timeline_rssi(spark, sf), scaled, Q)


@query(
    "pct_rank", "event_id:i session_id:i pct:f",
    """SELECT event_id, user_id % 4 AS session_id, (rank() OVER (PARTITION BY user_id % 4 ORDER BY v) + (count(*) OVER (PARTITION BY user_id % 4, v) - 1) / 2)
       / count(*) OVER (PARTITION BY user_id % 4) AS pct FROM (SELECT *, round(value, 1) AS v FROM events)""",
)
def _(spark, sf):
    ev = A.events(spark, sf).select("event_id", "session_id", F.round("value", 1).alias("v"))
    return byvalue.pct_rank(ev, ["session_id"], "v", "pct")
