"""Clustering, sleep, away, states and the whole inference chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..env import durable
from ..functions import timefn
from ..operators import cluster as cl
from ..operators import runs, sleep, states
from ..params import LOOKBACK_MINUTES, InferenceParams
from ..plans.inference import run_inference
from ..registry import query
from .adapting import vectors
from .clustering_sql import clustering_ctes
from .ctes import cte, with_ctes
from .ordering import Q, timeline, timeline_rssi

HOUR = 3600
P15 = InferenceParams(window_minutes=15, gap_context_minutes=90)
LOOKBACK15 = {k: [m * 3 for m in v] for k, v in LOOKBACK_MINUTES.items()}

cte(
    hx="""SELECT session_id, round(avg(value), 6) AS x FROM ev GROUP BY session_id, time_bucket(INTERVAL 1 HOUR, ts)""",
    km2="""SELECT session_id, arg_min({'u': x, 'a': s1 / n1, 'b': s2 / n2}, (sse, x)) AS m FROM (
       SELECT session_id, x, n1, s1, tn - n1 AS n2, ts - s1 AS s2, (q1 - s1 * s1 / n1) + (tq - q1 - (ts - s1) * (ts - s1) / (tn - n1)) AS sse FROM (
        SELECT session_id, x, sum(n) OVER o AS n1, sum(n * x) OVER o AS s1, sum(n * x * x) OVER o AS q1, sum(n) OVER p AS tn, sum(n * x) OVER p AS ts, sum(n * x * x) OVER p AS tq
        FROM (SELECT session_id, x, count(*) AS n FROM hx GROUP BY 1, 2) WINDOW o AS (PARTITION BY session_id ORDER BY x), p AS (PARTITION BY session_id)) WHERE tn > n1) GROUP BY 1""",
)


def hourly_values(spark, sf):
    return A.events(spark, sf).groupBy("session_id", timefn.floor_ts("ts", HOUR).alias("w")).agg(F.round(F.avg("value"), 6).alias("x"))


@query("kmeans1d_ordered", "session_id:i k:i upper:f center_1:f center_2:f",
       with_ctes("SELECT session_id, 2 AS k, m.u AS upper, round(m.a, 4) AS center_1, round(m.b, 4) AS center_2 FROM km2"))
def _(spark, sf):
    m = cl.kmeans1d_ordered(durable(cl.histogram(hourly_values(spark, sf), ["session_id"], "x")), ["session_id"], [2])
    return m.select("session_id", "k", F.col("uppers")[0].alias("upper"), F.round(F.col("centers")[0], 4).alias("center_1"), F.round(F.col("centers")[1], 4).alias("center_2"))


clustering_ctes("hour", "SELECT session_id, x FROM hx", (3, 4))
clustering_ctes("hlog", "SELECT session_id, ln(x) AS x FROM hx WHERE x > 0", (2, 3, 4), 20, 0.05, 0.25, 0.02)


@query("kmeans1d_ordered_k34", "session_id:i k:i center_1:f center_2:f center_3:f",
       with_ctes("SELECT session_id, k, max(CASE WHEN label = 1 THEN c END) AS center_1, max(CASE WHEN label = 2 THEN c END) AS center_2, max(CASE WHEN label = 3 THEN c END) AS center_3 FROM hour_cen GROUP BY 1, 2"))
def _(spark, sf):
    m = cl.kmeans1d_ordered(durable(cl.histogram(hourly_values(spark, sf), ["session_id"], "x")), ["session_id"], [3, 4])
    return m.select("session_id", "k", *[F.col("centers")[i].alias(f"center_{i + 1}") for i in range(3)])


@query("silhouette1d", "session_id:i k:i silhouette:f",
       with_ctes("""SELECT session_id, 2 AS k, avg(CASE WHEN nown <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (
          SELECT p.session_id, p.i, sum(CAST(p.c = q.c AS INT)) AS nown, sum(CASE WHEN p.c = q.c THEN abs(p.x - q.x) END) / (sum(CAST(p.c = q.c AS INT)) - 1) AS a, avg(CASE WHEN p.c <> q.c THEN abs(p.x - q.x) END) AS b
          FROM pts p JOIN pts q USING (session_id) GROUP BY 1, 2) GROUP BY 1""",
                 pts="SELECT session_id, x, x <= m.u AS c, row_number() OVER () AS i FROM hx JOIN km2 USING (session_id)"))
def _(spark, sf):
    h = durable(cl.histogram(hourly_values(spark, sf), ["session_id"], "x"))
    return cl.silhouette1d(h, cl.kmeans1d_ordered(h, ["session_id"], [2]), ["session_id"])


def lloyd_sql(values: str, probs: list[float], mean: str, rounds: int, tolerance: float) -> str:
    """(session_id, c: ascending centres) by Lloyd iteration over ``values(session_id, x)`` from
    quantile seeds, an empty cluster keeping its centre (oracle side)."""
    away = "list_transform(c, lambda q: abs(q - x))"
    new = ", ".join(f"coalesce(max(m) FILTER (WHERE l = {i}), any_value(c)[{i}])" for i in range(1, len(probs) + 1))
    return f"""WITH RECURSIVE step AS (
        SELECT session_id, 0 AS i, quantile_cont(x, {probs}) AS c, true AS moved FROM {values} GROUP BY 1
        UNION ALL SELECT session_id, i + 1, new, list_max(list_transform(list_zip(new, old), lambda p: abs(p[1] - p[2]))) >= {tolerance} FROM (
          SELECT session_id, i, any_value(c) AS old, [{new}] AS new FROM (
            SELECT session_id, i, l, any_value(c) AS c, {mean} AS m FROM (
              SELECT s.session_id, s.i, s.c, v.x, list_position({away}, list_min({away})) AS l FROM step s JOIN {values} v USING (session_id) WHERE s.moved AND s.i < {rounds})
            GROUP BY 1, 2, 3) GROUP BY 1, 2))
      SELECT session_id, list_sort(arg_max(c, i)) AS c FROM step GROUP BY 1"""


@query("kmeans1d_quantile_lloyd", "session_id:i center_1:f center_2:f center_3:f center_4:f boundary_2:f",
       with_ctes("SELECT session_id, 10 ** c[1] AS center_1, 10 ** c[2] AS center_2, 10 ** c[3] AS center_3, 10 ** c[4] AS center_4, 10 ** ((c[2] + c[3]) / 2) AS boundary_2 FROM (" + lloyd_sql("logs", [0.05, 0.35, 0.65, 0.95], "avg(x)", 200, 1e-12) + ")",
                 logs="SELECT session_id, log10(x) AS x FROM hx WHERE x > 0"))
def _(spark, sf):
    v = hourly_values(spark, sf).filter("x > 0").withColumn("lx", F.log10("x"))
    m = cl.quantile_lloyd(v, ["session_id"], "lx", 4)
    b = cl.log_boundaries(F.col("centers"), "10")
    return m.select("session_id", *[F.pow(F.lit(10.0), F.col("centers")[i]).alias(f"center_{i + 1}") for i in range(4)], b[1].alias("boundary_2"))


@query("kmedians1d_trim", "session_id:i center_1:f center_2:f",
       with_ctes("SELECT session_id, c[1] AS center_1, c[2] AS center_2 FROM (" + lloyd_sql("inner_values", [0.25, 0.75], "quantile_cont(x, 0.5)", 100, 1e-6) + ")",
                 inner_values="SELECT session_id, x FROM hx JOIN (SELECT session_id, quantile_cont(x, [0.01, 0.99]) AS q FROM hx GROUP BY 1) USING (session_id) WHERE x BETWEEN q[1] AND q[2]"))
def _(spark, sf):
    m = cl.kmedians_trim(hourly_values(spark, sf), ["session_id"], "x")
    return m.select("session_id", F.col("centers")[0].alias("center_1"), F.col("centers")[1].alias("center_2"))


@query("choose_ordered_clustering", "session_id:i k:i silhouette:f minimum_cluster_count:i required_cluster_count:i accepted:b separation_tier:s minimum_center_ratio:f selected:b",
       with_ctes("SELECT session_id, k, silhouette, coalesce(least_n, 0) AS minimum_cluster_count, required AS required_cluster_count, accepted, tier AS separation_tier, ratio AS minimum_center_ratio, selected FROM hlog_dia"))
def _(spark, sf):
    v = hourly_values(spark, sf).withColumn("lx", F.log("x"))
    return cl.choose_ordered_clustering(v, ["session_id"], "lx", (2, 3, 4), 20, 0.05, 0.25, 0.02)[1]


def movement15(spark, sf):
    t = durable(timeline(spark, sf))
    return t.select("session_id", "w", F.col("av").alias("movement_value"), F.lit("acc").alias("movement_source"))


clustering_ctes("move", "SELECT session_id, ln(greatest(av, 1e-6)) AS x FROM tl WHERE av IS NOT NULL", (2, 3, 4), 20, 0.05, 0.25, 0.02)


@query("classify_movement", "session_id:i w:t movement_state:i movement_k:i movement_resolved:b low_motion:b low_motion_threshold:f",
       with_ctes("""SELECT t.session_id, t.w, l.label AS movement_state, d.k AS movement_k, d.k IS NOT NULL AS movement_resolved, coalesce(l.label = 1, false) AS low_motion, exp((a.c + b.c) / 2) AS low_motion_threshold FROM tl t
         LEFT JOIN (SELECT session_id, k FROM move_dia WHERE selected) d USING (session_id) LEFT JOIN move_lab l ON l.session_id = t.session_id AND l.k = d.k AND l.x = ln(greatest(t.av, 1e-6)) AND t.av IS NOT NULL
         LEFT JOIN move_cen a ON a.session_id = t.session_id AND a.k = d.k AND a.label = 1 LEFT JOIN move_cen b ON b.session_id = t.session_id AND b.k = d.k AND b.label = 2"""))
def _(spark, sf):
    return cl.classify_movement(movement15(spark, sf), P15)[0]


@query("bootstrap_median_ci", "session_id:i ci_low:f ci_high:f")
def _(spark, sf):
    return cl.bootstrap_median_ci(hourly_values(spark, sf), ["session_id"], "x")


@query("rssi_vector_kmeans", "session_id:i w:t cluster:i training:b")
def _(spark, sf):
    return cl.rssi_vector_kmeans(vectors(spark, sf), ["rssi_click", "rssi_error", "rssi_purchase", "rssi_signup", "rssi_view"])[0]


# -- sleep -----------------------------------------------------------------------
cte(
    epr="""SELECT b.session_id, b.candidate_id AS episode_id, b."start", b."end", b.duration_minutes, b.low_motion_share, d.target AS dominant_beacon, x.room AS dominant_room, coalesce(d.dn, 0) AS dominant_count,
       coalesce(d.total, 0) AS observed_windows, d.dn / d.total AS dominant_share, coalesce(d.dn / d.total >= 0.6, false) AS room_supported, b.duration_minutes >= 120 AS main_sleep
      FROM bouts b LEFT JOIN epdom d USING (session_id, candidate_id) LEFT JOIN beacons x ON x.beacon = d.target""",
)


def rule_episodes(t):
    """Episodes with room evidence; main sleep by a fixed length here, so that
    the steps after the clustering can be compared with SQL."""
    ep = runs.bridged_bouts(t, "low_motion", Q, 900).withColumnRenamed("candidate_id", "episode_id")
    ep = sleep.episode_room(t, ep, Q)
    return ep.withColumns({"main_sleep": F.col("duration_minutes") >= 120, "room_correction_eligible": F.col("room_supported")})


@query("episode_room", "session_id:i episode_id:i start:t end:t dominant_beacon:s dominant_room:s dominant_count:i observed_windows:i dominant_share:f room_supported:b", with_ctes("SELECT * FROM epr"))
def _(spark, sf):
    return rule_episodes(durable(timeline(spark, sf)))


clustering_ctes("slp", "SELECT session_id, ln(duration_minutes) AS x FROM bouts", P15.sleep_candidates, P15.sleep_min_per_cluster, 0.0, P15.sleep_silhouette_min, P15.near_best_silhouette, P15.sleep_silhouette_borderline_min, P15.sleep_borderline_center_ratio)


@query("main_sleep", "session_id:i episode_id:i start:t duration_minutes:f duration_cluster:i main_sleep:b sleep_resolved:b",
       with_ctes("""SELECT e.session_id, e.candidate_id AS episode_id, e."start", e.duration_minutes, l.label AS duration_cluster, coalesce(l.label = d.k, false) AS main_sleep, d.k IS NOT NULL AS sleep_resolved FROM bouts e
         LEFT JOIN (SELECT session_id, k FROM slp_dia WHERE selected) d USING (session_id) LEFT JOIN slp_lab l ON l.session_id = e.session_id AND l.k = d.k AND l.x = ln(e.duration_minutes)"""))
def _(spark, sf):
    b = runs.bridged_bouts(durable(timeline(spark, sf)), "low_motion", Q, 900)
    return states.main_sleep(b.withColumnRenamed("candidate_id", "episode_id"), P15)[0]


ZONES = {0: "UTC", 1: "Asia/Tokyo", 2: "Etc/GMT+7", 3: "UTC"}


def zoned_sessions(spark, sf):
    zone = F.when(F.col("session_id") == 1, ZONES[1]).when(F.col("session_id") == 2, ZONES[2]).otherwise("UTC")
    return A.events(spark, sf).select("session_id").distinct().withColumn("timezone", zone)


@query("infer_bedroom", "session_id:i bedroom_source:s bedroom_beacons:s bedroom_inferred:b support_nights:i support_share:f",
       with_ctes("""SELECT s.session_id, CASE WHEN b.beacon IS NULL THEN 'unresolved' ELSE 'inferred_cross_night' END AS bedroom_source, coalesce(b.beacon, '') AS bedroom_beacons, b.beacon IS NOT NULL AS bedroom_inferred,
         b.nights AS support_nights, b.share AS support_share FROM (SELECT DISTINCT session_id FROM ev) s LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY nights DESC, tot DESC, round(share, 9) DESC, beacon) AS r FROM (
          SELECT session_id, dominant_beacon AS beacon, count(DISTINCT CAST("start" + CASE session_id WHEN 1 THEN INTERVAL 9 HOUR WHEN 2 THEN INTERVAL (-7) HOUR ELSE INTERVAL 0 HOUR END AS DATE)) AS nights,
           sum(dominant_count) / sum(observed_windows) AS share, sum(observed_windows) AS tot FROM epr WHERE main_sleep AND room_supported GROUP BY 1, 2) WHERE nights >= 2 AND share >= 0.6) WHERE r = 1) b USING (session_id)"""))
def _(spark, sf):
    return sleep.infer_bedroom(rule_episodes(durable(timeline(spark, sf))), zoned_sessions(spark, sf))


cte(
    gsup="""SELECT g.*, coalesce(before_n >= 1 AND after_n >= 1 AND before_share >= 2 / 3 AND after_share >= 2 / 3, false) AS supported FROM gapctx g""",
    slk="""SELECT t.session_id, t.w, t.beacon AS raw_beacon, t.room AS raw_room, t.observed AS rssi_observed, t.low_motion, t.av, e.episode_id AS sleep_episode_id, e.episode_id IS NOT NULL AS main_sleep, g."start" IS NOT NULL AS sleep_gap_filled,
       CASE WHEN (e.room_supported AND t.beacon IS NOT NULL) OR g."start" IS NOT NULL THEN e.dominant_beacon ELSE t.beacon END AS corrected_beacon,
       CASE WHEN (e.room_supported AND t.beacon IS NOT NULL) OR g."start" IS NOT NULL THEN e.dominant_room ELSE t.room END AS corrected_room,
       CASE WHEN g."start" IS NOT NULL THEN 'sleep_gap_two_sided_room_support' WHEN e.room_supported AND t.beacon <> e.dominant_beacon THEN 'sleep_episode_dominant_room' ELSE 'none' END AS correction_reason,
       CASE WHEN g."start" IS NOT NULL THEN 'sleep_gap_context_filled' WHEN e.room_supported AND t.beacon IS NOT NULL THEN 'sleep_episode_locked' WHEN t.observed THEN 'observed_raw' ELSE 'missing' END AS location_evidence
      FROM tl t LEFT JOIN epr e ON e.main_sleep AND e.session_id = t.session_id AND t.w >= e."start" AND t.w < e."end"
      LEFT JOIN gsup g ON g.supported AND e.room_supported AND g.session_id = e.session_id AND g.candidate_id = e.episode_id AND t.w >= g."start" AND t.w < g."end\"""",
)


def locked(spark, sf):
    t = durable(timeline(spark, sf))
    base = t.withColumns({"base_beacon": F.col("beacon"), "base_room": F.col("room"), "rssi_observed": F.col("observed"), "raw_beacon": F.col("beacon"), "raw_room": F.col("room")})
    return sleep.sleep_correction(base.drop("beacon", "room"), durable(rule_episodes(t)), Q, P15)


@query("sleep_lock", "session_id:i w:t sleep_episode_id:i main_sleep:b corrected_beacon:s corrected_room:s correction_reason:s location_evidence:s sleep_gap_filled:b", with_ctes("SELECT * FROM slk"))
def _(spark, sf):
    return locked(spark, sf)


@query("sleep_gap_fill", "session_id:i start:t end:t target:s before_n:i before_share:f after_n:i after_share:f supported:b", with_ctes("SELECT * FROM gsup"))
def _(spark, sf):
    t = durable(timeline(spark, sf))
    gaps = sleep.gaps_in_episodes(t, durable(rule_episodes(t)), Q)
    return sleep.gap_support(gaps, t, Q, 5400, 2 / 3)


cte(
    gone="""SELECT *, count(*) OVER (PARTITION BY session_id) AS runs FROM (SELECT session_id, min(w) AS "start", max(w) + INTERVAL 15 MINUTE AS "end", count(*) * 15.0 AS duration_minutes FROM (
      SELECT session_id, w, w - INTERVAL 15 MINUTE * row_number() OVER (PARTITION BY session_id ORDER BY w) AS isl FROM tl WHERE NOT observed) GROUP BY session_id, isl)""",
)
clustering_ctes("away", f"SELECT session_id, ln(duration_minutes) AS x FROM gone WHERE runs >= {P15.away_min_runs}", (2,), P15.away_min_per_cluster, 0.0, P15.away_silhouette_min, 0.0, P15.away_silhouette_borderline_min, P15.away_center_ratio)


@query("away_runs", "session_id:i start:t end:t duration_minutes:f duration_cluster:i probable_away:b away_resolved:b",
       with_ctes(f"""SELECT e.session_id, e."start", e."end", e.duration_minutes, l.label AS duration_cluster, coalesce(l.label = 2, false) AS probable_away, d.k IS NOT NULL AS away_resolved FROM gone e
         LEFT JOIN (SELECT session_id, k FROM away_dia WHERE selected AND ratio >= {P15.away_center_ratio}) d USING (session_id) LEFT JOIN away_lab l ON l.session_id = e.session_id AND l.k = d.k AND l.x = ln(e.duration_minutes)"""))
def _(spark, sf):
    t = durable(timeline(spark, sf)).withColumns({"rssi_observed": F.col("observed"), "wearable_online": F.lit(True), "main_sleep": F.lit(False)})
    return states.away_runs(t, P15)[0]


# states from flags derived per row
cte(
    stt="""SELECT *, CASE WHEN occupancy_state = 'probable_away' THEN 'away' WHEN main_sleep THEN 'main_sleep' WHEN sleep_candidate AND NOT main_sleep AND NOT sleep_resolved THEN 'sleep_unresolved'
        WHEN movement_resolved THEN 'awake' ELSE 'movement_unresolved' END AS behaviour_state FROM (
      SELECT *, CASE WHEN sleep_gap_filled THEN 'indoor_inferred_sleep' WHEN probable_away THEN 'probable_away' WHEN rssi_observed THEN 'indoor_observed' ELSE 'unknown' END AS occupancy_state FROM (
       SELECT *, NOT rssi_observed AND coalesce(av > 60, false) AS probable_away, low_motion AS sleep_candidate, session_id <> 3 AS sleep_resolved, session_id <> 2 AS movement_resolved FROM slk))""",
)


def stated(spark, sf):
    t = locked(spark, sf).withColumns(
        {
            "probable_away": ~F.col("rssi_observed") & F.coalesce(F.col("av") > 60, F.lit(False)), "sleep_candidate": F.col("low_motion"),
            "sleep_resolved": F.col("session_id") != 3, "movement_resolved": F.col("session_id") != 2,
        }
    ).withColumn("occupancy_state", states.occupancy_state())
    return t.withColumn("behaviour_state", states.behaviour_state())


@query("occupancy_state", "session_id:i w:t occupancy_state:s", with_ctes("SELECT * FROM stt"))
def _(spark, sf):
    return stated(spark, sf)


@query("behaviour_state", "session_id:i w:t behaviour_state:s", with_ctes("SELECT * FROM stt"))
def _(spark, sf):
    return stated(spark, sf)


cte(
    amr="""SELECT * REPLACE (CASE WHEN behaviour_state IN ('awake', 'movement_unresolved') AND NOT rssi_observed THEN NULL ELSE corrected_beacon END AS corrected_beacon,
      CASE WHEN behaviour_state IN ('awake', 'movement_unresolved') AND NOT rssi_observed THEN NULL ELSE corrected_room END AS corrected_room) FROM stt""",
)


@query("awake_missing_rule", "session_id:i w:t corrected_beacon:s corrected_room:s", with_ctes("SELECT * FROM amr"))
def _(spark, sf):
    return states.awake_missing_rule(stated(spark, sf))


def _moves(col: str) -> str:
    return f"(SELECT session_id, sum(CASE WHEN r <> p AND w - pw = INTERVAL 15 MINUTE THEN 1 ELSE 0 END) AS m FROM (SELECT session_id, w, {col} AS r, lag({col}) OVER o AS p, lag(w) OVER o AS pw FROM amr WHERE {col} IS NOT NULL WINDOW o AS (PARTITION BY session_id ORDER BY w)) GROUP BY 1)"


@query("session_audit", "session_id:i window_count:i raw_observed_fraction:f corrected_observed_fraction:f corrected_window_count:i sleep_gap_filled_windows:i raw_transition_count:i corrected_transition_count:i",
       with_ctes(f"""SELECT a.*, b.m AS raw_transition_count, c.m AS corrected_transition_count FROM (SELECT session_id, count(*) AS window_count, avg(CAST(rssi_observed AS INT)) AS raw_observed_fraction, count(corrected_beacon) / count(*) AS corrected_observed_fraction,
         count(*) FILTER (WHERE coalesce(corrected_beacon, '') <> coalesce(raw_beacon, '')) AS corrected_window_count, count(*) FILTER (WHERE sleep_gap_filled) AS sleep_gap_filled_windows FROM amr GROUP BY 1) a
         JOIN {_moves('raw_room')} b USING (session_id) JOIN {_moves('corrected_room')} c USING (session_id)"""))
def _(spark, sf):
    return states.session_audit(durable(states.awake_missing_rule(stated(spark, sf))), Q)


cte(
    nep="""SELECT n.*, d.b, d.n / d.t AS sh FROM nights n JOIN (SELECT session_id, episode_id, arg_min(beacon, (-n, beacon)) AS b, max(n) AS n, sum(n) AS t FROM (SELECT n.session_id, n.episode_id, t.beacon, count(*) AS n FROM nights n
      JOIN tl t ON t.session_id = n.session_id AND t.w >= n."start" AND t.w < n."end" GROUP BY 1, 2, 3) GROUP BY 1, 2) d USING (session_id, episode_id)""",
)


@query("sleep_candidates_night", "session_id:i night:d episode_count:i total_minutes:f longest_minutes:f longest_start:t longest_end:t longest_beacon:s longest_share:f",
       with_ctes("""SELECT session_id, night, count(*) AS episode_count, sum(duration_minutes) AS total_minutes, max(CASE WHEN r = 1 THEN duration_minutes END) AS longest_minutes, max(CASE WHEN r = 1 THEN "start" END) AS longest_start,
         max(CASE WHEN r = 1 THEN "end" END) AS longest_end, max(CASE WHEN r = 1 THEN b END) AS longest_beacon, max(CASE WHEN r = 1 THEN sh END) AS longest_share FROM (SELECT *, row_number() OVER (PARTITION BY session_id, night ORDER BY duration_minutes DESC, "start") AS r FROM nep) GROUP BY 1, 2"""))
def _(spark, sf):
    return sleep.nightly_summary(night_episodes(spark, sf))


def night_episodes(spark, sf):
    t = durable(timeline(spark, sf))
    ep = runs.night_runs(t, "low_motion", Q, 18, 10, 45, split_nights=True, beacon="beacon")
    return sleep.episode_room(t, ep, Q)


@query("sleep_beacon_ranking", "session_id:i dominant_beacon:s episode_count:i total_minutes:f mean_share:f nights_present:i minutes_fraction:f rank:i",
       with_ctes("""SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY nights_present DESC, total_minutes DESC, round(mean_share, 9) DESC, dominant_beacon) AS rank, total_minutes / sum(total_minutes) OVER (PARTITION BY session_id) AS minutes_fraction FROM (
         SELECT session_id, b AS dominant_beacon, count(*) AS episode_count, sum(duration_minutes) AS total_minutes, avg(sh) AS mean_share, count(DISTINCT night) AS nights_present FROM nep GROUP BY 1, 2)"""))
def _(spark, sf):
    return sleep.beacon_ranking(night_episodes(spark, sf))


@query("episode_clock_boundary", "session_id:i boundary_start:s boundary_end:s",
       with_ctes("""SELECT session_id, printf('%02d:%02d', a // 60, a % 60) AS boundary_start, printf('%02d:%02d', b // 60, b % 60) AS boundary_end FROM (
         SELECT session_id, (CAST(round_even(quantile_cont((hour("start") * 60 + minute("start") + 720) % 1440, 0.05) - 60 + 720, 0) AS INT) + 1440) % 1440 AS a,
          (CAST(round_even(quantile_cont((hour("end") * 60 + minute("end") + 720) % 1440, 0.95) + 60 + 720, 0) AS INT) + 1440) % 1440 AS b FROM nights GROUP BY 1)"""))
def _(spark, sf):
    return sleep.episode_clock_boundary(night_episodes(spark, sf))


# -- whole chain -----------------------------------------------------------------
def inference(spark, sf):
    t = durable(timeline(spark, sf))
    movement = t.select("session_id", "w", F.col("av").alias("movement_value"), F.lit("acc").alias("movement_source"))
    online = t.select("session_id", "w", F.col("n").isNotNull().alias("wearable_online"))
    return run_inference(
        t.select("session_id", "w"), durable(timeline_rssi(spark, sf)), movement, online, A.beacons(spark).select("beacon", "room"), zoned_sessions(spark, sf), P15, lookback=LOOKBACK15
    )


@query("run_inference", "session_id:i w:t raw_beacon:s raw_room:s corrected_beacon:s corrected_room:s movement_state:i main_sleep:b occupancy_state:s behaviour_state:s correction_reason:s location_evidence:s location_confidence:s adaptive_window_minutes:i was_corrected:b")
def _(spark, sf):
    return inference(spark, sf).timeline


@query("run_inference_audit", "session_id:i window_count:i raw_observed_fraction:f corrected_observed_fraction:f raw_transition_count:i corrected_transition_count:i movement_k:i main_sleep_episode_count:i away_run_count:i bedroom_source:s")
def _(spark, sf):
    return inference(spark, sf).audit
