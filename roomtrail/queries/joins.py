"""Interval, as-of and alignment joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..env import durable
from ..functions import timefn
from ..operators import intervals as op
from ..operators import runs, topk
from ..operators import windows as win
from ..registry import query
from .ctes import cte, with_ctes
from .ordering import Q, floor_shifts, observed_timeline, timeline
from .scalar import validity

HOUR = 3600

cte(
    ovl="""SELECT session_id, w, label, sum(s) AS seconds FROM (SELECT session_id, w, label,
        (epoch_us(least("end", w + INTERVAL 1 HOUR)) - epoch_us(greatest("start", w))) / 1000000.0 AS s FROM (
        SELECT *, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, "start"), time_bucket(INTERVAL 1 HOUR, "end"), INTERVAL 1 HOUR)) AS w FROM ivl WHERE "start" < "end"))
      WHERE s > 0 GROUP BY 1, 2, 3""",
    domlab="""SELECT session_id, w, label, seconds / 3600 AS overlap_fraction FROM (SELECT *, row_number() OVER (PARTITION BY session_id, w
      ORDER BY round(seconds, 6) DESC, label) AS r FROM ovl) WHERE r = 1""",
    hgrid="""SELECT session_id, unnest(generate_series(min(w), max(w), INTERVAL 1 HOUR)) AS w FROM rw GROUP BY 1""",
)


@query("join_overlap_majority", "session_id:i w:t strongest_beacon:s label:s overlap_fraction:f",
       with_ctes("SELECT session_id, w, strongest_beacon, label, overlap_fraction FROM rtop JOIN domlab USING (session_id, w) WHERE overlap_fraction >= 0.5"))
def _(spark, sf):
    top = topk.strongest_beacon(win.rssi_window_agg(A.rssi_samples(spark, sf), HOUR))
    return op.join_overlap_majority(top, A.intervals(spark, sf), HOUR)


@query("join_overlap_majority_by_sensor", "session_id:i w:t label:s user_id:i overlap_fraction:f",
       with_ctes("""SELECT session_id, w, label, user_id, seconds / 3600 AS overlap_fraction FROM (SELECT *, row_number() OVER (PARTITION BY session_id, w ORDER BY round(seconds, 6) DESC, label, user_id) AS r
         FROM (SELECT session_id, w, label, user_id, sum((epoch_us(least("end", w + INTERVAL 1 HOUR)) - epoch_us(greatest("start", w))) / 1000000.0) AS seconds FROM (
          SELECT *, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, "start"), time_bucket(INTERVAL 1 HOUR, "end"), INTERVAL 1 HOUR)) AS w FROM ivl WHERE "start" < "end")
          WHERE least("end", w + INTERVAL 1 HOUR) > greatest("start", w) GROUP BY 1, 2, 3, 4)) WHERE r = 1"""))
def _(spark, sf):
    return op.dominant_label(A.intervals(spark, sf), HOUR, ("label", "user_id"))


@query("join_overlap_dominant", "session_id:i w:t label:s overlap_fraction:f",
       with_ctes("""SELECT session_id, w, coalesce(label, 'Unknown') AS label, coalesce(overlap_fraction, 0) AS overlap_fraction FROM hgrid LEFT JOIN domlab2 USING (session_id, w)""",
                 domlab2="""SELECT session_id, w, label, seconds / 3600 AS overlap_fraction FROM (SELECT *, row_number() OVER (PARTITION BY session_id, w ORDER BY round(seconds, 6) DESC, label) AS r
                   FROM (SELECT session_id, w, label, sum((epoch_us(least(e, w + INTERVAL 1 HOUR)) - epoch_us(greatest(ts, w))) / 1000000.0) AS seconds FROM (
                    SELECT session_id, event_type AS label, ts, ts + INTERVAL 10 MINUTE AS e, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts + INTERVAL 10 MINUTE), INTERVAL 1 HOUR)) AS w FROM ev)
                    WHERE least(e, w + INTERVAL 1 HOUR) > greatest(ts, w) GROUP BY 1, 2, 3)) WHERE r = 1"""))
def _(spark, sf):
    short = A.events(spark, sf).select("session_id", F.col("event_type").alias("label"), F.col("ts").alias("start"), timefn.shift_ts("ts", 600).alias("end"))
    grid = win.window_grid(win.rssi_window_agg(A.rssi_samples(spark, sf), HOUR), HOUR)
    return op.join_overlap_dominant(grid, short, HOUR)


HOURS_OUT = " ".join(f"h{h:02d}:s" for h in range(24))
HOURS_SQL = ", ".join(f"max(CASE WHEN hour(w) = {h} THEN label END) AS h{h:02d}" for h in range(24))


@query("join_overlap_dominant_pivot", f"session_id:i day:d {HOURS_OUT}",
       with_ctes(f"SELECT session_id, CAST(w AS DATE) AS day, {HOURS_SQL} FROM (SELECT session_id, w, coalesce(label, 'Unknown') AS label FROM hgrid LEFT JOIN domlab USING (session_id, w)) GROUP BY 1, 2"))
def _(spark, sf):
    grid = win.window_grid(win.rssi_window_agg(A.rssi_samples(spark, sf), HOUR), HOUR)
    return op.day_hour_matrix(op.join_overlap_dominant(grid, A.intervals(spark, sf), HOUR), "label")


# overlapping two-hour intervals: the last one that started wins
cte(ivo="""SELECT session_id, event_id AS seq, ts AS "start", ts + INTERVAL 2 HOUR AS "end", event_type AS label FROM ev""")


def overlapping(spark, sf):
    return A.events(spark, sf).select(
        "session_id", F.col("event_id").alias("seq"), F.col("ts").alias("start"), timefn.shift_ts("ts", 2 * HOUR).alias("end"), F.col("event_type").alias("label")
    )


@query("join_point_interval", "session_id:i w:t label:s closed_label:s",
       with_ctes("""SELECT g.session_id, g.w, (SELECT arg_max(label, seq) FROM ivo i WHERE i.session_id = g.session_id AND g.w >= i."start" AND g.w < i."end") AS label,
         (SELECT arg_max(label, seq) FROM ivo i WHERE i.session_id = g.session_id AND g.w >= i."start" AND g.w <= i."end") AS closed_label FROM hgrid g"""))
def _(spark, sf):
    grid = win.window_grid(win.rssi_window_agg(A.rssi_samples(spark, sf), HOUR), HOUR)
    iv = overlapping(spark, sf)
    half = op.join_grid_interval(grid, iv, HOUR)
    return op.join_grid_interval(half.withColumnRenamed("label", "half"), iv, HOUR, closed=True).select(
        "session_id", "w", F.col("half").alias("label"), F.col("label").alias("closed_label")
    )


@query("join_point_interval_samples", "event_id:i session_id:i label:s",
       with_ctes("""SELECT e.event_id, e.session_id, arg_max(i.label, i.seq) AS label FROM (SELECT *, (session_id + 1) % 4 AS other FROM ev) e
         LEFT JOIN ivo i ON i.session_id = e.other AND e.ts >= i."start" AND e.ts < i."end" GROUP BY 1, 2"""))
def _(spark, sf):
    points = A.events(spark, sf).select("event_id", "ts", F.col("session_id").alias("own"), ((F.col("session_id") + 1) % 4).alias("session_id"))
    out = op.join_point_interval(points, overlapping(spark, sf), ["event_id"], HOUR)
    return out.select("event_id", F.col("own").alias("session_id"), "label")


@query("join_scd_room", "session_id:i w:t beacon:s room:s",
       with_ctes("""SELECT p.session_id, p.w, p.beacon, coalesce(arg_max(v.room, v.seq), 'Unmapped') AS room FROM (
          SELECT DISTINCT user_id AS session_id, event_type AS beacon, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events) p
         LEFT JOIN validity v ON v.session_id = p.session_id AND v.beacon = p.beacon AND v.valid_from <= p.w AND (v.valid_to IS NULL OR v.valid_to > p.w) GROUP BY 1, 2, 3"""))
def _(spark, sf):
    ev = A.events(spark, sf)
    w = ev.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("beacon"), timefn.floor_ts("ts", HOUR).alias("w")).distinct()
    return op.join_scd_room(w, validity(spark, sf))


@query("join_asof_nearest", "event_id:i session_id:i near_id:i near_value:f",
       with_ctes("""SELECT event_id, session_id, CASE WHEN bt IS NOT NULL AND (aft IS NULL OR ts - bt <= aft - ts) THEN CASE WHEN ts - bt <= INTERVAL 20 MINUTE THEN bid END
           WHEN aft - ts <= INTERVAL 20 MINUTE THEN aid END AS near_id,
          CASE WHEN bt IS NOT NULL AND (aft IS NULL OR ts - bt <= aft - ts) THEN CASE WHEN ts - bt <= INTERVAL 20 MINUTE THEN bv END
           WHEN aft - ts <= INTERVAL 20 MINUTE THEN av END AS near_value FROM (
         SELECT e.event_id, e.session_id, e.ts, b.ts AS bt, b.event_id AS bid, b.value AS bv, a.ts AS aft, a.event_id AS aid, a.value AS av
         FROM (SELECT * FROM ev WHERE event_type <> 'view') e
         ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') b ON b.session_id = e.session_id AND e.ts >= b.ts
         ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') a ON a.session_id = e.session_id AND e.ts <= a.ts)"""))
def _(spark, sf):
    ev = A.events(spark, sf).select("session_id", "ts", "event_id", "event_type", "value")
    right = ev.filter("event_type = 'view'").select("session_id", "ts", F.col("event_id").alias("near_id"), F.col("value").alias("near_value"))
    left = ev.filter("event_type <> 'view'").select("session_id", "ts", "event_id")
    return op.join_asof_nearest(left, right, ["near_id", "near_value"], 1200, ties=["event_id"], right_tie="near_id")


@query("join_episode_windows", "session_id:i w:t candidate_id:i in_episode:b",
       with_ctes("""SELECT t.session_id, t.w, b.candidate_id, b.candidate_id IS NOT NULL AS in_episode FROM tl t LEFT JOIN bouts b
         ON b.session_id = t.session_id AND t.w >= b."start" AND t.w < b."end\""""))
def _(spark, sf):
    t = timeline(spark, sf)
    return op.join_episode_windows(t, runs.bridged_bouts(t, "low_motion", Q, 900), Q, ["candidate_id"])


@query("join_shift_windows", "session_id:i w:t near_supported_shift:b near_unsupported_shift:b",
       with_ctes("""SELECT t.session_id, t.w, coalesce(bool_or(s.supported), false) AS near_supported_shift, coalesce(bool_or(NOT s.supported), false) AS near_unsupported_shift
         FROM otl t LEFT JOIN shifts s ON s.session_id = t.session_id AND t.w BETWEEN s.support_start AND s.support_end GROUP BY 1, 2"""))
def _(spark, sf):
    return op.join_shift_windows(observed_timeline(spark, sf), floor_shifts(spark, sf), Q)


cte(
    epdom="""SELECT session_id, candidate_id, arg_min(beacon, (-n, beacon)) AS target, max(n) AS dn, sum(n) AS total FROM (SELECT b.session_id, b.candidate_id, t.beacon, count(*) AS n
      FROM bouts b JOIN tl t ON t.session_id = b.session_id AND t.w >= b."start" AND t.w < b."end" AND t.beacon IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    epgaps="""SELECT b.session_id, b.candidate_id, b."start" AS episode_start, b."end" AS episode_end, d.target, min(g.w) AS "start", max(g.w) + INTERVAL 15 MINUTE AS "end" FROM (
       SELECT session_id, w, candidate_id, w - INTERVAL 15 MINUTE * row_number() OVER (PARTITION BY session_id, candidate_id ORDER BY w) AS isl FROM (
        SELECT t.session_id, t.w, b.candidate_id FROM tl t JOIN bouts b ON b.session_id = t.session_id AND t.w >= b."start" AND t.w < b."end" WHERE t.beacon IS NULL)) g
      JOIN bouts b USING (session_id, candidate_id) JOIN epdom d USING (session_id, candidate_id) GROUP BY 1, 2, 3, 4, 5, g.isl""",
    gapctx="""SELECT g.session_id, g.candidate_id, g."start", g."end", g.target,
      count(CASE WHEN t.w < g."start" THEN 1 END) AS before_n, avg(CASE WHEN t.w < g."start" THEN CAST(t.beacon = g.target AS INT) END) AS before_share,
      count(CASE WHEN t.w >= g."end" THEN 1 END) AS after_n, avg(CASE WHEN t.w >= g."end" THEN CAST(t.beacon = g.target AS INT) END) AS after_share
      FROM epgaps g LEFT JOIN tl t ON t.session_id = g.session_id AND t.beacon IS NOT NULL AND ((t.w >= greatest(g."start" - INTERVAL 90 MINUTE, g.episode_start) AND t.w < g."start")
        OR (t.w >= g."end" AND t.w < least(g."end" + INTERVAL 90 MINUTE, g.episode_end))) GROUP BY 1, 2, 3, 4, 5""",
)


def episode_gaps(t, episodes, window_s=Q):
    """Missing runs inside each episode with the episode's dominant beacon."""
    from ..operators.sleep import gaps_in_episodes

    return gaps_in_episodes(t, episodes, window_s)


@query("join_gap_context", "session_id:i start:t end:t target:s before_n:i before_share:f after_n:i after_share:f", with_ctes("SELECT * FROM gapctx"))
def _(spark, sf):
    t = durable(timeline(spark, sf))
    ep = runs.bridged_bouts(t, "low_motion", Q, 900).withColumnRenamed("candidate_id", "episode_id")
    return op.join_gap_context(episode_gaps(t, ep), t, Q, 5400)


cte(
    prs="SELECT DISTINCT user_id // 2 AS pair_id FROM events",
    utl="""SELECT session_id, w, beacon, room FROM (SELECT *, row_number() OVER (PARTITION BY session_id, w ORDER BY m DESC, beacon) AS r FROM (
      SELECT user_id AS session_id, time_bucket(INTERVAL 6 HOUR, ts) AS w, event_type AS beacon, avg(-(40 + value % 50)) AS m FROM events GROUP BY 1, 2, 3)) JOIN beacons USING (beacon) WHERE r = 1""",
)


def user_rooms(spark, sf, window_s=6 * HOUR):
    """Every user as a session of their own: strongest room per window."""
    ev = A.events(spark, sf).select(F.col("user_id").alias("session_id"), "ts", F.col("event_type").alias("beacon"), (-(F.lit(40) + F.col("value") % 50)).alias("rssi"))
    return topk.strongest_beacon(win.rssi_window_agg(ev, window_s), A.beacons(spark))


def user_pairs(spark, sf):
    p = A.events(spark, sf).select(F.floor(F.col("user_id") / 2).cast("bigint").alias("pair_id")).distinct()
    return p.withColumns({"left_session": F.col("pair_id") * 2, "right_session": F.col("pair_id") * 2 + 1})


@query("join_pair_inner", "pair_id:i w:t left_strongest_beacon:s right_strongest_beacon:s left_room:s right_room:s",
       with_ctes("""SELECT pair_id, w, l.beacon AS left_strongest_beacon, r.beacon AS right_strongest_beacon, l.room AS left_room, r.room AS right_room
         FROM prs JOIN utl l ON l.session_id = pair_id * 2 JOIN utl r USING (w) WHERE r.session_id = pair_id * 2 + 1"""))
def _(spark, sf):
    return op.join_pair_inner(user_rooms(spark, sf), user_pairs(spark, sf), ["strongest_beacon", "room"])


@query("join_multi_method", "session_id:i w:t strongest:s reference:s mode:s",
       with_ctes("""SELECT g.session_id, g.w, coalesce(r.strongest_beacon, 'Unmapped') AS strongest, coalesce(d.label, 'Unmapped') AS reference, coalesce(m.m, 'Unmapped') AS mode FROM hgrid g
         LEFT JOIN rtop r USING (session_id, w) LEFT JOIN (SELECT * FROM domlab WHERE overlap_fraction >= 0.5) d USING (session_id, w)
         LEFT JOIN (SELECT session_id, w, arg_min(beacon, (-rssi_cnt, beacon)) AS m FROM rw GROUP BY 1, 2) m USING (session_id, w)"""))
def _(spark, sf):
    w = win.rssi_window_agg(A.rssi_samples(spark, sf), HOUR)
    strongest = topk.strongest_beacon(w).select("session_id", "w", F.col("strongest_beacon").alias("v"))
    ref = op.dominant_label(A.intervals(spark, sf), HOUR).filter("overlap_fraction >= 0.5").select("session_id", "w", F.col("label").alias("v"))
    mode = topk.mode_label(w, ["session_id", "w"], "beacon", "rssi_cnt").select("session_id", "w", F.col("beacon").alias("v"))
    return op.join_multi_method(win.window_grid(w, HOUR), {"strongest": strongest, "reference": ref, "mode": mode}, "v")


cte(
    clu="""SELECT session_id, w, CAST(rssi_available_beacons AS INT) AS cluster, gap_db, rssi_sample_count FROM rtop""",
    prof="""SELECT session_id, cluster, count(*) AS training_windows, avg(gap_db) AS mean_gap FROM clu GROUP BY 1, 2""",
)


def hourly_clusters(spark, sf):
    """Hourly rows grouped by how many beacons were heard (stand-in clusters)."""
    top = topk.strongest_beacon(win.rssi_window_agg(A.rssi_samples(spark, sf), HOUR))
    c = top.select("session_id", "w", F.col("rssi_available_beacons").cast("int").alias("cluster"), "gap_db", "rssi_sample_count")
    p = c.groupBy("session_id", "cluster").agg(F.count("*").alias("training_windows"), F.avg("gap_db").alias("mean_gap"))
    return c, p


@query("join_floor_cluster", "session_id:i w:t beacon:s cluster:i training_windows:i mean_gap:f",
       with_ctes("""SELECT t.session_id, t.w, t.beacon, c.cluster, p.training_windows, p.mean_gap FROM tl t LEFT JOIN clu c ON c.session_id = t.session_id AND c.w = time_bucket(INTERVAL 1 HOUR, t.w)
         LEFT JOIN prof p ON p.session_id = c.session_id AND p.cluster = c.cluster"""))
def _(spark, sf):
    c, p = hourly_clusters(spark, sf)
    return op.join_floor_cluster(timeline(spark, sf).select("session_id", "w", "beacon"), c.select("session_id", "w", "cluster"), p, HOUR)


cte(
    mrw="""SELECT session_id, window_s, w, room, samples, gap_db FROM (SELECT session_id, window_s, w, max(CASE WHEN r = 1 THEN beacon END) AS b, sum(c) AS samples,
       max(CASE WHEN r = 1 THEN m END) - max(CASE WHEN r = 2 THEN m END) AS gap_db FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id, window_s, w ORDER BY m DESC, beacon) AS r FROM (
         SELECT session_id, s AS window_s, to_timestamp(epoch_us(ts) // (s * 1000000) * s)::TIMESTAMP AS w, beacon, avg(rssi) AS m, count(*) AS c
         FROM (SELECT *, unnest([300, 900, 1800]::BIGINT[]) AS s FROM rssi) GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2, 3) JOIN beacons ON b = beacon""",
)


def sized_rooms(spark, sf, sizes=(300, 900, 1800)):
    """Strongest room for several window sizes from one scan."""
    samples = A.rssi_samples(spark, sf)
    width = F.col("window_s").cast("bigint") * 1_000_000
    cells = (
        samples.select("*", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("window_s"))
        .groupBy("session_id", "window_s", F.timestamp_micros(F.floor(F.unix_micros("ts") / width).cast("bigint") * width).alias("w"), "beacon")
        .agg(F.avg("rssi").alias("rssi_mean"), F.count("*").alias("rssi_cnt"))
    )
    top = topk.strongest_beacon(cells, A.beacons(spark), keys=("session_id", "window_s", "w"))
    return top.withColumnRenamed("rssi_sample_count", "samples")


@query("join_reference_windows", "event_id:i session_id:i label:s room_5m:s samples_5m:i room_15m:s gap_db_15m:f room_30m:s samples_30m:i gap_db_30m:f",
       with_ctes("""SELECT i.event_id, i.session_id, i.label, coalesce(a.room, 'Out') AS room_5m, coalesce(a.samples, 0) AS samples_5m, coalesce(b.room, 'Out') AS room_15m, b.gap_db AS gap_db_15m,
         coalesce(c.room, 'Out') AS room_30m, coalesce(c.samples, 0) AS samples_30m, c.gap_db AS gap_db_30m FROM ivl i
         LEFT JOIN mrw a ON a.session_id = i.session_id AND a.window_s = 300 AND a.w = time_bucket(INTERVAL 5 MINUTE, i."start")
         LEFT JOIN mrw b ON b.session_id = i.session_id AND b.window_s = 900 AND b.w = time_bucket(INTERVAL 15 MINUTE, i."start")
         LEFT JOIN mrw c ON c.session_id = i.session_id AND c.window_s = 1800 AND c.w = time_bucket(INTERVAL 30 MINUTE, i."start")"""))
def _(spark, sf):
    return op.join_reference_windows(A.intervals(spark, sf), sized_rooms(spark, sf), (300, 900, 1800))
