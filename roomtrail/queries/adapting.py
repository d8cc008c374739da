"""Activity levels, window selection, calibration, hybrid decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import timefn
from ..operators import activity as ac
from ..operators import adaptive as ad
from ..operators import calibration as cal
from ..operators import intervals as iv
from ..operators import metrics as me
from ..operators import topk
from ..operators import windows as win
from ..registry import query
from .ctes import cte, with_ctes
from .joins import hourly_clusters
from .reports import evidence
from .scalar import window_evidence

HOUR = 3600

# -- activity ------------------------------------------------------------------
cte(
    act="""SELECT g.session_id, g.w, coalesce(s.steps_in_window, 0) AS steps, coalesce(s.step_samples, 0) AS step_samples, a.acc_std, a.acc_range, coalesce(a.n, 0) AS acc_count FROM hgrid g
      LEFT JOIN stepw s USING (session_id, w) LEFT JOIN (SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, round(stddev_pop(value), 6) AS acc_std, max(value) - min(value) AS acc_range, count(*) AS n FROM ev GROUP BY 1, 2) a USING (session_id, w)""",
    acts="""SELECT a.session_id, a.w, CASE WHEN (hour(a.w) >= 22 OR hour(a.w) < 7) AND steps <= sl THEN 'Sleep' WHEN steps <= sed THEN 'Sedentary' WHEN steps <= li THEN 'Light activity' ELSE 'Moderate to Vigorous activity' END AS step_activity
      FROM act a JOIN (SELECT *, greatest(5, least(15, sed / 2)) AS sl FROM (SELECT session_id, greatest(10, least(40, coalesce(quantile_cont(steps, 0.4) FILTER (WHERE steps > 0), 0))) AS sed,
        greatest(80, least(180, coalesce(quantile_cont(steps, 0.8) FILTER (WHERE steps > 0), 0))) AS li FROM act GROUP BY 1)) q USING (session_id)""",
    acta="""SELECT a.session_id, a.w, CASE WHEN (hour(a.w) >= 22 OR hour(a.w) < 7) AND coalesce(acc_std, 0) <= sl THEN 'Sleep' WHEN coalesce(acc_std, 0) <= sed THEN 'Sedentary' WHEN coalesce(acc_std, 0) <= li THEN 'Light activity' ELSE 'Moderate to Vigorous activity' END AS acc_activity
      FROM act a JOIN (SELECT session_id, quantile_cont(acc_std, 0.2) FILTER (WHERE acc_std > 0) AS sl, quantile_cont(acc_std, 0.4) FILTER (WHERE acc_std > 0) AS sed, quantile_cont(acc_std, 0.8) FILTER (WHERE acc_std > 0) AS li FROM act GROUP BY 1) q USING (session_id)""",
    actall="""SELECT a.*, s.step_activity, x.acc_activity, CASE WHEN hour(a.w) % 2 = 0 THEN s.step_activity ELSE x.acc_activity END AS fused_activity, e.room
      FROM act a JOIN acts s USING (session_id, w) JOIN acta x USING (session_id, w) LEFT JOIN evd e USING (session_id, w)""",
)


def activity_windows(spark, sf):
    from .scalar import windows as w_op

    cells = win.rssi_window_agg(A.rssi_samples(spark, sf), HOUR)
    inc = w_op.step_increments(A.step_samples(spark, sf), ["event_id"])
    w = timefn.floor_ts("ts", HOUR).alias("w")
    steps = inc.groupBy("session_id", w).agg(F.sum("increment").alias("steps"), F.count("cnt").alias("step_samples"))
    acc = A.events(spark, sf).groupBy("session_id", w).agg(
        F.round(F.stddev_pop("value"), 6).alias("acc_std"), (F.max("value") - F.min("value")).alias("acc_range"), F.count("*").alias("acc_count")
    )
    grid = win.window_grid(cells, HOUR)
    return grid.join(steps, ["session_id", "w"], "left").join(acc, ["session_id", "w"], "left").na.fill(0, ["steps", "step_samples", "acc_count"])


@query("activity_from_steps", "session_id:i w:t step_activity:s", with_ctes("SELECT * FROM acts"))
def _(spark, sf):
    return ac.activity_from_steps(activity_windows(spark, sf))


@query("activity_from_acc", "session_id:i w:t acc_activity:s", with_ctes("SELECT * FROM acta"))
def _(spark, sf):
    return ac.activity_from_acc(activity_windows(spark, sf))


@query("activity_fused", "session_id:i w:t fused_activity:s")
def _(spark, sf):
    return ac.activity_fused(activity_windows(spark, sf))


def all_activity(spark, sf):
    a = ac.activity_from_acc(ac.activity_from_steps(activity_windows(spark, sf)))
    a = a.withColumn("fused_activity", F.when(F.hour("w") % 2 == 0, F.col("step_activity")).otherwise(F.col("acc_activity")))
    return a.join(evidence(spark, sf).select("session_id", "w", "room"), ["session_id", "w"], "left")


@query("activity_context", "session_id:i w:t context:s",
       with_ctes("""SELECT session_id, w, CASE WHEN r = 'Bedroom' AND n AND lo >= 2 THEN 'Bedroom + night + low activity' WHEN r = 'Bedroom' AND hi > 0 THEN 'Bedroom + high activity'
          WHEN r IN ('Indoor transition', 'Out', 'Other 2') AND hi > 0 THEN 'Transition/Out + high activity' WHEN s IN ('Sleep', 'Sedentary') AND a NOT IN ('Sleep', 'Sedentary') THEN 'possible non-walking movement'
          WHEN s = a THEN 'step and acceleration agree' ELSE 'step and acceleration differ' END AS context FROM (
         SELECT session_id, w, coalesce(room, 'Unknown') AS r, hour(w) >= 22 OR hour(w) < 7 AS n, step_activity AS s, acc_activity AS a,
          CAST(step_activity IN ('Sleep','Sedentary') AS INT) + CAST(acc_activity IN ('Sleep','Sedentary') AS INT) + CAST(fused_activity IN ('Sleep','Sedentary') AS INT) AS lo,
          3 - (CAST(step_activity IN ('Sleep','Sedentary') AS INT) + CAST(acc_activity IN ('Sleep','Sedentary') AS INT) + CAST(fused_activity IN ('Sleep','Sedentary') AS INT)) AS hi FROM actall)"""))
def _(spark, sf):
    return ac.activity_context(all_activity(spark, sf))


@query("activity_disagreement", "session_id:i w:t steps:f acc_std:f step_activity:s acc_activity:s score:f rank:i",
       with_ctes("""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, w) AS rank FROM (SELECT session_id, w, steps, acc_std, step_activity, acc_activity,
          abs((rank() OVER (PARTITION BY session_id ORDER BY steps) + (count(*) OVER (PARTITION BY session_id, steps) - 1) / 2) / count(steps) OVER (PARTITION BY session_id)
           - CASE WHEN acc_std IS NOT NULL THEN (rank() OVER (PARTITION BY session_id ORDER BY acc_std) + (count(*) OVER (PARTITION BY session_id, acc_std) - 1) / 2) / count(acc_std) OVER (PARTITION BY session_id) END) AS score
         FROM actall WHERE step_activity <> acc_activity))"""))
def _(spark, sf):
    return ac.activity_disagreement(all_activity(spark, sf))


@query("activity_level_distribution", "session_id:i method:s level:s windows:i agreement:f",
       with_ctes("""SELECT t.session_id, m.method, l.level, (SELECT count(*) FROM u WHERE u.session_id = t.session_id AND u.method = m.method AND u.level = l.level) AS windows, t.agreement FROM
          (SELECT session_id, avg(CAST(step_activity = acc_activity AS INT)) AS agreement FROM actall GROUP BY 1) t, (SELECT unnest(['step_activity','acc_activity','fused_activity']) AS method) m,
          (SELECT unnest(['Sleep','Sedentary','Light activity','Moderate to Vigorous activity']) AS level) l""",
                 u="SELECT session_id, 'step_activity' AS method, step_activity AS level FROM actall UNION ALL SELECT session_id, 'acc_activity', acc_activity FROM actall UNION ALL SELECT session_id, 'fused_activity', fused_activity FROM actall"))
def _(spark, sf):
    return ac.level_distribution(all_activity(spark, sf))


cte(
    shp="""SELECT session_id, epoch_us(min(w)) // 1000 AS "start", epoch_us(max(w)) // 1000 + 3600000 AS "end", any_value(step_activity) AS label FROM (
       SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY w) AS g FROM (SELECT *, CASE WHEN step_activity = lag(step_activity) OVER (PARTITION BY session_id ORDER BY w) THEN 0 ELSE 1 END AS c FROM acts)) GROUP BY session_id, g""",
)


@query("sink_annotation_shapes", "session_id:i start:i end:i label:s", with_ctes("SELECT * FROM shp"))
def _(spark, sf):
    """Shapes written as JSON lines and read back through the annotation source."""
    from ..env import scratch_path
    from ..sources import annotations as ann

    shapes = ac.annotation_shapes(ac.activity_from_steps(activity_windows(spark, sf)), "step_activity", HOUR)
    path = scratch_path(spark, "shapes")
    ann.write_shapes(shapes, path)
    return ann.read_shape_lines(spark, path, "activityLevel").select(
        "session_id", F.unix_millis("start").alias("start"), F.unix_millis("end").alias("end"), "label"
    )


@query("chk_shapes", "session_id:i start:i end:i label:s problem:s",
       with_ctes("""SELECT session_id, s AS "start", e AS "end", label, CASE WHEN s >= e THEN 'invalid_interval' WHEN s < p THEN 'overlap' WHEN bad THEN 'invalid_label' END AS problem FROM (
         SELECT *, lag(e) OVER (PARTITION BY session_id ORDER BY s, e) AS p, label NOT IN ('Sleep','Sedentary','Light activity','Moderate to Vigorous activity') AS bad FROM (
          SELECT user_id AS session_id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + CAST(floor((value - 5) * 600000) AS BIGINT) AS e, CASE WHEN event_type = 'error' THEN 'error' ELSE 'Sedentary' END AS label FROM events))
         WHERE s >= e OR s < p OR bad"""))
def _(spark, sf):
    start = F.floor(F.unix_micros("ts") / 1000).cast("bigint")
    label = F.when(F.col("event_type") == "error", "error").otherwise("Sedentary")
    s = A.events(spark, sf).select(
        F.col("user_id").alias("session_id"), start.alias("start"), (start + F.floor((F.col("value") - 5) * 600000).cast("bigint")).alias("end"), label.alias("label")
    )
    return ac.invalid_shapes(s)


# -- window selection -----------------------------------------------------------
SIZES = (14400, 7200, 3600, 1800)
THRESHOLDS = (50, 100, 200, 400)
cte(
    szd="""SELECT a.session_id, a.window_s, a.w, a.room, a.samples, a.gap_db, d.dominance, s.steps FROM (
        SELECT session_id, window_s, w, max(CASE WHEN r = 1 THEN room END) AS room, sum(c) AS samples, max(CASE WHEN r = 1 THEN m END) - max(CASE WHEN r = 2 THEN m END) AS gap_db FROM (
         SELECT *, row_number() OVER (PARTITION BY session_id, window_s, w ORDER BY m DESC, beacon) AS r FROM (SELECT session_id, s AS window_s, to_timestamp(epoch_us(ts) // (s * 1000000) * s)::TIMESTAMP AS w, beacon,
          avg(rssi) AS m, count(*) AS c FROM (SELECT *, unnest([1800, 3600, 7200, 14400]::BIGINT[]) AS s FROM rssi) GROUP BY 1, 2, 3, 4)) JOIN beacons USING (beacon) GROUP BY 1, 2, 3) a
      JOIN (SELECT session_id, window_s, w, max(n) / sum(n) AS dominance FROM (SELECT session_id, s AS window_s, to_timestamp(epoch_us(ts) // (s * 1000000) * s)::TIMESTAMP AS w, beacon, count(*) AS n
         FROM (SELECT *, unnest([1800, 3600, 7200, 14400]::BIGINT[]) AS s FROM rssi) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) d USING (session_id, window_s, w)
      JOIN (SELECT session_id, s AS window_s, to_timestamp(epoch_us(ts) // (s * 1000000) * s)::TIMESTAMP AS w, sum(increment) AS steps FROM (SELECT *, unnest([1800, 3600, 7200, 14400]::BIGINT[]) AS s FROM inc) GROUP BY 1, 2, 3) s USING (session_id, window_s, w)""",
    ali="""SELECT g.session_id, g.w, a.steps AS s4, b.steps AS s2, c.steps AS s1, d.steps AS s0, a.room AS r4, b.room AS r2, c.room AS r1, d.room AS r0, a.dominance AS d4, b.dominance AS d2, c.dominance AS d1, a.gap_db AS g4, b.gap_db AS g2, c.gap_db AS g1
      FROM (SELECT session_id, unnest(generate_series(min(w), max(w), INTERVAL 30 MINUTE)) AS w FROM szd WHERE window_s = 1800 GROUP BY 1) g
      LEFT JOIN szd a ON a.session_id = g.session_id AND a.window_s = 14400 AND a.w = time_bucket(INTERVAL 4 HOUR, g.w) LEFT JOIN szd b ON b.session_id = g.session_id AND b.window_s = 7200 AND b.w = time_bucket(INTERVAL 2 HOUR, g.w)
      LEFT JOIN szd c ON c.session_id = g.session_id AND c.window_s = 3600 AND c.w = time_bucket(INTERVAL 1 HOUR, g.w) LEFT JOIN szd d ON d.session_id = g.session_id AND d.window_s = 1800 AND d.w = g.w""",
    wbs="""SELECT session_id, w, th AS threshold_steps, CASE WHEN s4 <= th THEN 14400 WHEN s2 <= th THEN 7200 WHEN s1 <= th THEN 3600 ELSE 1800 END AS selected_window,
      CASE WHEN s4 <= th THEN r4 WHEN s2 <= th THEN r2 WHEN s1 <= th THEN r1 ELSE r0 END AS room FROM (SELECT *, unnest([50, 100, 200, 400]) AS th FROM ali)""",
)


def sized_evidence(spark, sf, sizes=SIZES):
    """Room, gap, dominance and steps for every window size, one scan each of
    signal and steps."""
    arr = F.array(*[F.lit(s) for s in sizes])
    width = F.col("window_s").cast("bigint") * 1_000_000
    w = F.timestamp_micros(F.floor(F.unix_micros("ts") / width).cast("bigint") * width).alias("w")
    keys = ["session_id", "window_s", "w"]
    cells = A.rssi_samples(spark, sf).select("*", F.explode(arr).alias("window_s")).groupBy("session_id", "window_s", w, "beacon").agg(
        F.avg("rssi").alias("rssi_mean"), F.count("*").alias("rssi_cnt")
    )
    top = topk.strongest_beacon(cells, A.beacons(spark), keys)
    dom = cells.groupBy(*keys).agg((F.max("rssi_cnt") / F.sum("rssi_cnt")).alias("dominance"))
    inc = win.step_increments(A.step_samples(spark, sf), ["event_id"]).select("*", F.explode(arr).alias("window_s"))
    steps = inc.groupBy("session_id", "window_s", w).agg(F.sum("increment").alias("steps"))
    return top.join(dom, keys).join(steps, keys).select(*keys, "room", F.col("rssi_sample_count").alias("samples"), "gap_db", "dominance", "steps")


def aligned(spark, sf):
    sized = sized_evidence(spark, sf)
    anchors = win.window_grid(sized.filter("window_s = 1800"), 1800)
    return win.align_floor(anchors, sized, SIZES, ("steps", "room", "dominance", "gap_db"))


def stepwise(spark, sf):
    rows = ad.window_by_steps(aligned(spark, sf), THRESHOLDS, SIZES[:-1], SIZES[-1])
    return ad.pick_sized(rows, ["room"], SIZES)


@query("window_by_steps", "session_id:i w:t threshold_steps:f selected_window:i possible_transition:b room:s",
       with_ctes("SELECT *, selected_window = 1800 AS possible_transition FROM wbs"))
def _(spark, sf):
    return stepwise(spark, sf)


@query("window_by_stability", "session_id:i w:t stability_window:i",
       with_ctes("""SELECT session_id, w, CASE WHEN coalesce(s4, 0) <= 400 AND coalesce(d4, 0) >= 0.3 AND coalesce(g4, 0) >= 1 THEN 14400 WHEN coalesce(s2, 0) <= 200 AND coalesce(d2, 0) >= 0.4 AND coalesce(g2, 0) >= 2 THEN 7200 ELSE 1800 END AS stability_window FROM ali"""))
def _(spark, sf):
    return ad.window_by_stability(aligned(spark, sf), (14400, 7200), (400, 200), (0.3, 0.4), (1, 2), 1800)


@query("predict_selected_window", "session_id:i w:t threshold_steps:f selected_window:i predicted:s", with_ctes("SELECT session_id, w, threshold_steps, selected_window, room AS predicted FROM wbs"))
def _(spark, sf):
    sized = sized_evidence(spark, sf).withColumnRenamed("room", "predicted")
    rows = ad.window_by_steps(aligned(spark, sf), THRESHOLDS, SIZES[:-1], SIZES[-1]).select("session_id", "w", "threshold_steps", "selected_window")
    return ad.predict_selected_window(rows, sized)


@query("window_choice_distribution", "session_id:i threshold_steps:f selected_window:i windows:i fraction:f",
       with_ctes("""SELECT t.session_id, t.threshold_steps, c.s AS selected_window, count(x.w) AS windows, count(x.w) / any_value(t.n) AS fraction FROM (SELECT session_id, threshold_steps, count(*) AS n FROM wbs GROUP BY 1, 2) t
         JOIN (SELECT unnest([14400, 7200, 3600, 1800]) AS s) c ON true LEFT JOIN wbs x ON x.session_id = t.session_id AND x.threshold_steps = t.threshold_steps AND x.selected_window = c.s GROUP BY 1, 2, 3"""))
def _(spark, sf):
    return ad.window_choice_distribution(stepwise(spark, sf), SIZES, ["session_id", "threshold_steps"])


cte(
    stat="""SELECT t.session_id, t.th AS threshold_steps, t.n, coalesce(a.k, 0) AS stationary_windows, coalesce(a.k, 0) / t.n AS coverage, a.mean_steps, a.mean_confidence, a.in_home_fraction, coalesce(a.tr, 0) AS transitions
      FROM (SELECT session_id, count(*) AS n, unnest([50, 100, 150, 200]) AS th FROM evd GROUP BY 1) t LEFT JOIN (SELECT session_id, th, count(*) AS k, avg(steps) AS mean_steps, avg(confidence) AS mean_confidence, avg(CAST(in_home AS INT)) AS in_home_fraction,
        sum(CAST(room <> p AS INT)) AS tr FROM (SELECT *, lag(room) OVER (PARTITION BY session_id, th ORDER BY w) AS p FROM (SELECT *, unnest([50, 100, 150, 200]) AS th FROM evd) WHERE steps <= th) GROUP BY 1, 2) a USING (session_id, th)""",
)


@query("stationary_threshold_eval", "session_id:i threshold_steps:f stationary_windows:i coverage:f mean_steps:f mean_confidence:f in_home_fraction:f transitions:i", with_ctes("SELECT * FROM stat"))
def _(spark, sf):
    return ad.stationary_thresholds(evidence(spark, sf), (50, 100, 150, 200))


@query("stationary_threshold", "threshold_steps:f mean_coverage:f mean_confidence:f mean_transitions:f coverage_score:f confidence_score:f transition_score:f selection_score:f selected:b",
       with_ctes("""SELECT *, threshold_steps = arg_max(threshold_steps, (round(selection_score, 9), -threshold_steps)) OVER () AS selected FROM (SELECT *, 0.4 * coverage_score + 0.35 * confidence_score + 0.25 * transition_score AS selection_score FROM (
         SELECT *, 1 - abs(mean_coverage - 0.35) AS coverage_score, (rank() OVER (ORDER BY round(mean_confidence, 9)) + (count(*) OVER (PARTITION BY round(mean_confidence, 9)) - 1) / 2) / count(*) OVER () AS confidence_score,
          1 - (rank() OVER (ORDER BY round(mean_transitions, 9)) + (count(*) OVER (PARTITION BY round(mean_transitions, 9)) - 1) / 2) / count(*) OVER () AS transition_score FROM (
          SELECT threshold_steps, avg(coverage) AS mean_coverage, avg(mean_confidence) AS mean_confidence, avg(transitions) AS mean_transitions FROM stat GROUP BY 1)))"""))
def _(spark, sf):
    return ad.select_stationary_threshold(ad.stationary_thresholds(evidence(spark, sf), (50, 100, 150, 200)))


cte(
    cuts="""SELECT session_id, 100.0 AS stationary_max, CASE WHEN q50 <= mn THEN q75 ELSE q50 END AS low_max, q90 AS active_max FROM (SELECT session_id, quantile_cont(steps, 0.5) AS q50, quantile_cont(steps, 0.75) AS q75, quantile_cont(steps, 0.9) AS q90, min(steps) AS mn FROM evd WHERE steps > 100 GROUP BY 1)""",
    mst="""SELECT a.*, CASE WHEN s1 <= stationary_max THEN 'stationary' WHEN s1 <= low_max THEN 'low_movement' WHEN s1 <= active_max THEN 'active' ELSE 'high_activity' END AS movement_state FROM (SELECT * REPLACE (coalesce(s1, 0) AS s1) FROM ali) a JOIN cuts USING (session_id)""",
)


@query("movement_cuts", "session_id:i stationary_max:f low_max:f active_max:f", with_ctes("SELECT * FROM cuts"))
def _(spark, sf):
    return ad.movement_cuts(evidence(spark, sf), 100)


@query("adaptive_by_state", "session_id:i w:t movement_state:s selected_window:i possible_transition:b room:s",
       with_ctes("""SELECT session_id, w, movement_state, CASE movement_state WHEN 'stationary' THEN 14400 WHEN 'low_movement' THEN 7200 WHEN 'active' THEN 3600 ELSE 1800 END AS selected_window, movement_state = 'high_activity' AS possible_transition,
         CASE movement_state WHEN 'stationary' THEN r4 WHEN 'low_movement' THEN r2 WHEN 'active' THEN r1 ELSE r0 END AS room FROM mst"""))
def _(spark, sf):
    rows = aligned(spark, sf).withColumn("steps", F.coalesce("steps_60m", F.lit(0.0)))
    rows = ad.movement_state(rows, ad.movement_cuts(evidence(spark, sf), 100))
    return ad.adaptive_by_state(rows, ["room"], dict(zip(("stationary", "low_movement", "active", "high_activity"), SIZES)))


@query("movement_state_timeline", "pair_id:i w:t role:s movement_state:s",
       with_ctes("""SELECT pair_id, w, role, movement_state FROM (SELECT pair_id, l.w, 'left' AS role, l.movement_state FROM pairs JOIN mst l ON l.session_id = left_session JOIN mst r ON r.session_id = right_session AND r.w = l.w
         UNION ALL SELECT pair_id, l.w, 'right', r.movement_state FROM pairs JOIN mst l ON l.session_id = left_session JOIN mst r ON r.session_id = right_session AND r.w = l.w)"""))
def _(spark, sf):
    rows = aligned(spark, sf).withColumn("steps", F.coalesce("steps_60m", F.lit(0.0)))
    rows = ad.movement_state(rows, ad.movement_cuts(evidence(spark, sf), 100))
    both = iv.join_pair_inner(rows, A.pairs(spark), ["movement_state"])
    return both.unpivot(["pair_id", "w"], ["left_movement_state", "right_movement_state"], "role", "movement_state").withColumn("role", F.regexp_replace("role", "_movement_state", ""))


@query("step_threshold_diag", "session_id:i threshold_steps:f total_windows:i valid_windows:i missing_windows:i count_lte:i share_lte:f count_lte_missing_zero:i share_lte_missing_zero:f mean_steps:f median_steps:f p75_steps:f p90_steps:f max_steps:f",
       with_ctes("""SELECT session_id, th AS threshold_steps, count(*) AS total_windows, count(step_samples) FILTER (WHERE step_samples > 0) AS valid_windows, count(*) FILTER (WHERE step_samples = 0) AS missing_windows,
          count(*) FILTER (WHERE step_samples > 0 AND steps <= th) AS count_lte, count(*) FILTER (WHERE step_samples > 0 AND steps <= th) / count(*) FILTER (WHERE step_samples > 0) AS share_lte,
          count(*) FILTER (WHERE step_samples = 0 OR steps <= th) AS count_lte_missing_zero, count(*) FILTER (WHERE step_samples = 0 OR steps <= th) / count(*) AS share_lte_missing_zero,
          avg(steps) FILTER (WHERE step_samples > 0) AS mean_steps, quantile_cont(steps, 0.5) FILTER (WHERE step_samples > 0) AS median_steps, quantile_cont(steps, 0.75) FILTER (WHERE step_samples > 0) AS p75_steps,
          quantile_cont(steps, 0.9) FILTER (WHERE step_samples > 0) AS p90_steps, max(steps) FILTER (WHERE step_samples > 0) AS max_steps FROM (SELECT *, unnest([1, 2, 5, 10, 100, 200]) AS th FROM act) GROUP BY 1, 2"""))
def _(spark, sf):
    w = win.step_window_agg(win.step_increments(A.step_samples(spark, sf), ["event_id"]), HOUR, ["event_id"])
    return ad.step_threshold_diag(w, (1, 2, 5, 10, 100, 200), ["session_id"])


cte(
    hyb="""SELECT session_id, w, base, cr, CASE WHEN steps > 150 THEN 'not_30min_low_motion' WHEN NOT (cr NOT IN ('Unmapped', 'Out') AND tw >= 10 AND mg >= 8) THEN 'cluster_not_usable' WHEN gap_db >= 8 THEN 'strong_4b_evidence'
        WHEN gap_db IS NULL OR gap_db < 5 OR base IN ('Unmapped', 'Out') OR samples <= 0 THEN 'low_motion_weak_4b' ELSE '4b_not_ambiguous' END AS reason FROM (
      SELECT e.session_id, e.w, e.room AS base, e.gap_db, e.samples, e.steps, CASE c.cluster WHEN 1 THEN 'Out' WHEN 2 THEN 'Kitchen' WHEN 3 THEN 'Bathroom' ELSE 'Unmapped' END AS cr, p.training_windows AS tw, coalesce(p.mean_gap, 0) AS mg
      FROM evd e JOIN clu c USING (session_id, w) JOIN prof p ON p.session_id = c.session_id AND p.cluster = c.cluster)""",
)


def hybrid(spark, sf):
    c, p = hourly_clusters(spark, sf)
    e = evidence(spark, sf)
    rows = e.join(c.select("session_id", "w", "cluster"), ["session_id", "w"]).join(p, ["session_id", "cluster"])
    room = F.when(F.col("cluster") == 1, "Out").when(F.col("cluster") == 2, "Kitchen").when(F.col("cluster") == 3, "Bathroom").otherwise("Unmapped")
    rows = rows.select(
        "session_id", "w", F.col("room").alias("base_room"), F.col("gap_db").alias("base_gap"), F.col("samples").alias("base_samples"),
        F.when(F.col("steps") <= 150, 1800).otherwise(600).alias("selected_window"), room.alias("cluster_room"), "training_windows", F.col("mean_gap").alias("cluster_gap"),
    )
    return ad.hybrid_override(rows)


@query("hybrid_override", "session_id:i w:t final_room:s final_source:s override_used:b reason:s",
       with_ctes("""SELECT session_id, w, CASE WHEN reason = 'low_motion_weak_4b' THEN cr ELSE base END AS final_room, CASE WHEN reason = 'low_motion_weak_4b' THEN 'cluster_override' ELSE 'step_adaptive_rssi' END AS final_source,
         reason = 'low_motion_weak_4b' AS override_used, reason FROM hyb"""))
def _(spark, sf):
    return hybrid(spark, sf)


@query("override_summary", "session_id:i reason:s windows:i fraction:f",
       with_ctes("""SELECT session_id, reason, count(*) AS windows, count(*) / any_value(n) AS fraction FROM hyb JOIN (SELECT session_id, count(*) AS n FROM hyb GROUP BY 1) USING (session_id) GROUP BY 1, 2
         UNION ALL SELECT session_id, 'cluster_override_used_total', count(*) FILTER (WHERE reason = 'low_motion_weak_4b'), count(*) FILTER (WHERE reason = 'low_motion_weak_4b') / count(*) FROM hyb GROUP BY 1"""))
def _(spark, sf):
    return me.override_summary(hybrid(spark, sf), ["session_id"])


# -- calibration -------------------------------------------------------------
cte(
    lab="""SELECT r.session_id, r.w, r.strongest_beacon AS beacon, d.label AS reference FROM rtop r JOIN domlab d USING (session_id, w) WHERE overlap_fraction >= 0.5""",
)


def labelled(spark, sf):
    top = topk.strongest_beacon(win.rssi_window_agg(A.rssi_samples(spark, sf), HOUR))
    out = iv.join_overlap_majority(top, A.intervals(spark, sf), HOUR)
    return out.select("session_id", "w", F.col("strongest_beacon").alias("beacon"), F.col("label").alias("reference"))


@query("majority_calibration", "session_id:i w:t beacon:s reference:s predicted:s",
       with_ctes("""SELECT t.*, coalesce(m.p, f.p) AS predicted FROM lab t LEFT JOIN (SELECT session_id, beacon, arg_min(reference, (-n, reference)) AS p FROM (SELECT session_id, beacon, reference, count(*) AS n FROM tr GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (session_id, beacon)
         LEFT JOIN (SELECT session_id, arg_min(reference, (-n, reference)) AS p FROM (SELECT session_id, reference, count(*) AS n FROM tr GROUP BY 1, 2) GROUP BY 1) f USING (session_id)""",
                 tr="SELECT * FROM lab WHERE w < TIMESTAMP '2024-01-16 00:00:00'"))
def _(spark, sf):
    rows = labelled(spark, sf)
    return cal.majority_calibration(rows.filter("w < timestamp'2024-01-16 00:00:00'"), rows, ["session_id"])


def signature_sql(train: str, test: str, keys: list[str], row: list[str]) -> str:
    """Nearest signature per row (oracle side); sources have keys, row columns,
    feature, value, and the training one also room."""
    k = "".join(f"{c}, " for c in keys)
    on = " AND ".join([f"{{a}}.{c} = {{b}}.{c}" for c in [*keys, "feature"]])
    r = ", ".join(row)
    st = f"(SELECT {k}feature, avg(value) AS m, CASE WHEN coalesce(stddev_samp(value), 0) = 0 THEN 1 ELSE stddev_samp(value) END AS sd FROM {train} GROUP BY ALL)"
    sig = f"(SELECT {', '.join('t.' + c for c in [*keys, 'feature'])}, t.room, quantile_cont((t.value - s.m) / s.sd, 0.5) AS sig FROM {train} t JOIN {st} s ON {on.format(a='t', b='s')} GROUP BY ALL)"
    z = f"(SELECT t.*, (t.value - s.m) / s.sd AS z FROM {test} t JOIN {st} s ON {on.format(a='t', b='s')})"
    return f"""SELECT {k}{r}, arg_min(room, (round(d, 9), room)) AS predicted, min(d) AS distance FROM (
      SELECT {''.join('z.' + c + ', ' for c in keys)}{', '.join('z.' + c for c in row)}, g.room, sqrt(sum((z.z - g.sig) * (z.z - g.sig))) AS d FROM {z} z JOIN {sig} g ON {on.format(a='z', b='g')} GROUP BY ALL) GROUP BY ALL"""


@query("signature_match", "row_id:i predicted:s distance:f",
       with_ctes(signature_sql("emb", "emb", [], ["row_id"]),
                 emb="""SELECT row_id, room, feature, CAST(v AS DOUBLE) AS value FROM (SELECT vec_id AS row_id, 'r' || CAST(label AS VARCHAR) AS room, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS feature FROM embeddings)"""))
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    long = e.select(F.col("vec_id").alias("row_id"), F.concat(F.lit("r"), F.col("label").cast("string")).alias("room"), F.posexplode("embedding").alias("feature", "v"))
    long = long.select("row_id", "room", "feature", F.col("v").cast("double").alias("value"))
    return cal.signature_match(long, long, [])


def dated(spark, sf):
    return labelled(spark, sf).withColumn("day", F.to_date("w"))


@query("group_kfold", "session_id:i w:t day:d fold:i",
       with_ctes("SELECT lab.session_id, lab.w, d.day, p.fold FROM lab JOIN days d ON d.session_id = lab.session_id AND d.day = CAST(lab.w AS DATE) JOIN placed p ON p.session_id = d.session_id AND p.i = d.i",
                 days="""SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, day) AS i, least(5, count(*) OVER (PARTITION BY session_id)) AS k FROM (SELECT session_id, CAST(w AS DATE) AS day, count(*) AS n FROM lab GROUP BY 1, 2)""",
                 placed="""WITH RECURSIVE r AS (SELECT session_id, CAST(0 AS BIGINT) AS i, list_transform(range(k), lambda q: CAST(0 AS BIGINT)) AS loads, 0 AS fold FROM days WHERE i = 1
                   UNION ALL SELECT session_id, i, list_transform(loads, lambda v, j: CASE WHEN j = at_fold THEN v + n ELSE v END), at_fold FROM (
                     SELECT d.session_id, d.i, d.n, r.loads, list_position(r.loads, list_min(r.loads)) AS at_fold FROM r JOIN days d ON d.session_id = r.session_id AND d.i = r.i + 1)) SELECT * FROM r WHERE i > 0"""))
def _(spark, sf):
    return cal.group_kfold(dated(spark, sf), "day", 5, ["session_id"])


@query("cross_validated_majority", f"session_id:i fold:i w:t beacon:s reference:s predicted:s",
       with_ctes("""SELECT t.session_id, t.fold, t.w, t.beacon, t.reference, coalesce(m.p, f.p) AS predicted FROM fl t LEFT JOIN (SELECT session_id, fold, beacon, arg_min(reference, (-n, reference)) AS p FROM (
           SELECT a.session_id, k.fold, a.beacon, a.reference, count(*) AS n FROM fl a JOIN (SELECT DISTINCT session_id, fold FROM fl) k ON k.session_id = a.session_id AND k.fold <> a.fold GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) m USING (session_id, fold, beacon)
         LEFT JOIN (SELECT session_id, fold, arg_min(reference, (-n, reference)) AS p FROM (SELECT a.session_id, k.fold, a.reference, count(*) AS n FROM fl a JOIN (SELECT DISTINCT session_id, fold FROM fl) k ON k.session_id = a.session_id AND k.fold <> a.fold GROUP BY 1, 2, 3)
          GROUP BY 1, 2) f USING (session_id, fold)""", fl="SELECT *, day(w) % 5 + 1 AS fold FROM lab"))
def _(spark, sf):
    rows = labelled(spark, sf).withColumn("fold", F.dayofmonth("w") % 5 + 1)
    return cal.cross_validate_majority(rows, ["session_id"])


cte(
    lf="""SELECT r.session_id, r.w, day(r.w) % 5 + 1 AS fold, d.label AS room, f.feature, f.family, f.value FROM rtop r JOIN domlab d USING (session_id, w) JOIN (
        SELECT g.session_id, g.w, 'mean_' || b.beacon AS feature, 'rssi' AS family, coalesce(q.rssi_mean, -110) AS value FROM (SELECT DISTINCT session_id, w FROM rw) g JOIN beacons b ON true LEFT JOIN rw q ON q.session_id = g.session_id AND q.w = g.w AND q.beacon = b.beacon
        UNION ALL SELECT session_id, w, 'gap', 'summary', coalesce(gap_db, 0) FROM rtop UNION ALL SELECT session_id, w, 'steps', 'step', steps_in_window FROM stepw
        UNION ALL SELECT session_id, w, 'acc_std', 'acc', coalesce(acc_std, 0) FROM act) f USING (session_id, w) WHERE overlap_fraction >= 0.5""",
)
SWEEP = {
    "vector": ["rssi"], "vector_step": ["rssi", "step"], "vector_acc": ["rssi", "acc"], "vector_step_acc": ["rssi", "step", "acc"],
    "summary": ["rssi", "summary"], "summary_step": ["rssi", "summary", "step"], "summary_acc": ["rssi", "summary", "acc"], "summary_step_acc": ["rssi", "summary", "step", "acc"],
}
_FAM = ", ".join(f"('{m}', '{f}')" for m, fs in SWEEP.items() for f in fs)


def long_features(spark, sf):
    """Labelled windows as (row, feature, family, value) rows."""
    cells = win.rssi_window_agg(A.rssi_samples(spark, sf), HOUR)
    e = window_evidence(spark, sf)
    wide = cells.groupBy("session_id", "w").pivot("beacon", [b[0] for b in A.BEACON_ROWS]).agg(F.first("rssi_mean")).na.fill(-110.0)
    wide = wide.withColumnsRenamed({b[0]: f"mean_{b[0]}" for b in A.BEACON_ROWS})
    acc = activity_windows(spark, sf).select("session_id", "w", F.coalesce("acc_std", F.lit(0.0)).alias("acc_std"))
    wide = wide.join(e.select("session_id", "w", F.coalesce("gap_db", F.lit(0.0)).alias("gap"), F.col("steps_in_window").alias("steps")), ["session_id", "w"]).join(acc, ["session_id", "w"])
    wide = wide.join(labelled(spark, sf).select("session_id", "w", F.col("reference").alias("room")), ["session_id", "w"]).withColumn("fold", F.dayofmonth("w") % 5 + 1)
    cols = [c for c in wide.columns if c not in ("session_id", "w", "room", "fold")]
    long = wide.unpivot(["session_id", "w", "room", "fold"], cols, "feature", "value")
    fam = F.when(F.col("feature").startswith("mean_"), "rssi").when(F.col("feature") == "gap", "summary").when(F.col("feature") == "steps", "step").otherwise("acc")
    return long.withColumn("family", fam).withColumn("row_id", F.struct("session_id", "w"))


@query("feature_set_sweep", "method:s fold:i session_id:i w:t predicted:s",
       with_ctes("SELECT method, test_fold AS fold, session_id, w, predicted FROM (" + signature_sql("trn", "tst", ["method", "test_fold"], ["session_id", "w"]) + ")",
                 fam=f"SELECT * FROM (VALUES {_FAM}) t(method, family)", tst="SELECT lf.session_id, lf.w, lf.feature, lf.value, fam.method, fold AS test_fold FROM lf JOIN fam USING (family)",
                 trn="SELECT lf.session_id, lf.w, lf.room, lf.feature, lf.value, fam.method, k.k AS test_fold FROM lf JOIN fam USING (family) JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) k ON k.k <> lf.fold"))
def _(spark, sf):
    out = cal.feature_set_sweep(long_features(spark, sf), SWEEP)
    return out.select("method", F.col("test_fold").alias("fold"), F.col("row_id.session_id").alias("session_id"), F.col("row_id.w").alias("w"), "predicted")


# -- vectors and clusters --------------------------------------------------------
BEACONS5 = ["click", "error", "purchase", "signup", "view"]
cte(
    vec="""SELECT c.session_id, c.w, coalesce(max(CASE WHEN c.beacon = 'click' THEN rssi_mean END), -100) AS rssi_click, coalesce(max(CASE WHEN c.beacon = 'error' THEN rssi_mean END), -100) AS rssi_error, coalesce(max(CASE WHEN c.beacon = 'purchase' THEN rssi_mean END), -100) AS rssi_purchase,
       coalesce(max(CASE WHEN c.beacon = 'signup' THEN rssi_mean END), -100) AS rssi_signup, coalesce(max(CASE WHEN c.beacon = 'view' THEN rssi_mean END), -100) AS rssi_view,
       arg_min(c.beacon, (-rssi_mean, c.beacon)) AS beacon, list_sort(list(rssi_mean))[-1] - list_sort(list(rssi_mean))[-2] AS gap_db, sum(rssi_cnt) AS samples, coalesce(any_value(s.steps_in_window), 0) AS steps
      FROM rw c LEFT JOIN stepw s USING (session_id, w) GROUP BY 1, 2""",
    vecr="""SELECT v.*, b.room, steps <= 150 AS training, CASE WHEN gap_db IS NULL THEN 1 WHEN gap_db < 10 THEN 2 ELSE 3 END AS cluster FROM vec v JOIN beacons b USING (beacon)""",
)


def vectors(spark, sf):
    cells = win.rssi_window_agg(A.rssi_samples(spark, sf), HOUR)
    inc = win.step_increments(A.step_samples(spark, sf), ["event_id"])
    steps = inc.groupBy("session_id", timefn.floor_ts("ts", HOUR).alias("w")).agg(F.sum("increment").alias("steps"))
    return cal.rssi_vector_features(cells, BEACONS5, A.beacons(spark), steps, max_steps=150)


def gap_clusters(spark, sf):
    return vectors(spark, sf).withColumn("cluster", F.when(F.col("gap_db").isNull(), 1).when(F.col("gap_db") < 10, 2).otherwise(3))


@query("rssi_vector_features", "session_id:i w:t rssi_click:f rssi_error:f rssi_purchase:f rssi_signup:f rssi_view:f beacon:s room:s gap_db:f samples:i steps:f training:b",
       with_ctes("SELECT * FROM vecr"))
def _(spark, sf):
    return vectors(spark, sf)


cte(
    cprof="""SELECT a.*, b.dominant_beacon, b.dominant_room, p.predicted_windows FROM (SELECT session_id, cluster, count(*) AS training_windows, avg(samples) AS mean_samples, avg(gap_db) AS mean_gap_db, avg(steps) AS mean_steps,
        avg(nullif(rssi_click, -100)) AS mean_rssi_click, avg(nullif(rssi_view, -100)) AS mean_rssi_view FROM vecr WHERE training GROUP BY 1, 2) a
      JOIN (SELECT session_id, cluster, arg_min(beacon, (-n, beacon, room)) AS dominant_beacon, arg_min(room, (-n, beacon, room)) AS dominant_room FROM (SELECT session_id, cluster, beacon, room, count(*) AS n FROM vecr WHERE training GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) b USING (session_id, cluster)
      JOIN (SELECT session_id, cluster, count(*) AS predicted_windows FROM vecr GROUP BY 1, 2) p USING (session_id, cluster)""",
)


def profiles(spark, sf):
    v = gap_clusters(spark, sf)
    return cal.cluster_profiles(v.filter("training"), v, ["session_id"], features=["rssi_click", "rssi_view"])


@query("cluster_profiles", "session_id:i cluster:i training_windows:i predicted_windows:i dominant_beacon:s dominant_room:s mean_samples:f mean_gap_db:f mean_steps:f mean_rssi_click:f mean_rssi_view:f", with_ctes("SELECT * FROM cprof"))
def _(spark, sf):
    return profiles(spark, sf)


@query("attach_cluster_room", "session_id:i w:t cluster:i cluster_room:s cluster_label:s in_home:b",
       with_ctes("""SELECT v.session_id, v.w, v.cluster, coalesce(c.dominant_room, 'Unmapped') AS cluster_room, CAST(v.session_id AS VARCHAR) || '_C' || CAST(v.cluster AS VARCHAR) AS cluster_label, c.dominant_room IS NOT NULL AS in_home
         FROM vecr v LEFT JOIN cprof c USING (session_id, cluster)"""))
def _(spark, sf):
    return cal.attach_cluster_room(gap_clusters(spark, sf), profiles(spark, sf), ["session_id"])


cte(
    prel="""SELECT user_id AS session_id, event_type AS sensor, quantile_cont(1000 + value % 10 - m, 0.5) AS offset_hpa, quantile_cont(1000 + value % 10, 0.5) AS median_hpa FROM events
      JOIN (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS d, quantile_cont(1000 + value % 10, 0.5) AS m FROM events GROUP BY 1, 2) USING (user_id) WHERE d = time_bucket(INTERVAL 1 DAY, ts) GROUP BY 1, 2""",
)


@query("largest_gap_split", "session_id:i sensor:s offset_hpa:f group:s",
       with_ctes("""SELECT session_id, sensor, offset_hpa, CASE WHEN pos < at_pos THEN 'lower' ELSE 'higher' END AS "group" FROM (SELECT *, arg_max(pos, (coalesce(g, -1), -pos)) OVER (PARTITION BY session_id) AS at_pos FROM (
         SELECT *, round(offset_hpa - lag(offset_hpa) OVER o, 9) AS g, row_number() OVER o AS pos FROM prel WINDOW o AS (PARTITION BY session_id ORDER BY offset_hpa, sensor)) WHERE true)"""))
def _(spark, sf):
    p = A.pressure_samples(spark, sf).select("session_id", "ts", "event_id", "sensor", "hpa")
    ev = A.events(spark, sf).select("event_id", "user_id")
    p = p.drop("session_id").join(ev, "event_id").withColumnRenamed("user_id", "session_id").withColumn("d", timefn.floor_ts("ts", 86400))
    m = p.groupBy("session_id", "d").agg(F.percentile("hpa", F.lit(0.5)).alias("m"))
    off = p.join(m, ["session_id", "d"]).groupBy("session_id", "sensor").agg(F.percentile(F.col("hpa") - F.col("m"), F.lit(0.5)).alias("offset_hpa"))
    return cal.largest_gap_split(off, ["session_id"], "sensor", "offset_hpa")
