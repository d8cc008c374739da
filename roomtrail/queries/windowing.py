"""Window tables, grids, imputation, availability."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import timefn
from ..operators import windows as op
from ..registry import query
from .ctes import cte, with_ctes

HOUR = 3600

cte(
    rexp="""SELECT session_id, beacon, greatest(quantile_cont(rssi_cnt, 0.5), 1) AS expected FROM rw WHERE rssi_cnt > 0 GROUP BY 1, 2""",
    rq="""SELECT rw.session_id, rw.w, rw.beacon, rw.rssi_cnt, CASE WHEN rssi_cnt >= greatest(ceil(expected * 0.2), 1) THEN rssi_mean END AS rssi_mean,
       least(sum(rssi_cnt) OVER (PARTITION BY rw.session_id, rw.w) / t.total, 1) AS coverage
       FROM rw JOIN rexp USING (session_id, beacon) JOIN (SELECT session_id, sum(expected) AS total FROM rexp GROUP BY 1) t USING (session_id)""",
)


@query("rssi_window_agg", "session_id:i w:t beacon:s rssi_sum:f rssi_cnt:i rssi_mean:f", with_ctes("SELECT * FROM rw"))
def _(spark, sf):
    return op.rssi_window_agg(A.rssi_samples(spark, sf), HOUR)


@query("rssi_quality_filter", "session_id:i w:t beacon:s rssi_cnt:i rssi_mean:f coverage:f", with_ctes("SELECT * FROM rq"))
def _(spark, sf):
    return op.rssi_quality_filter(op.rssi_window_agg(A.rssi_samples(spark, sf), HOUR))


@query(
    "rssi_window_features",
    "session_id:i window_s:i w:t beacon:s rssi_mean:f rssi_median:f rssi_max:f rssi_var:f rssi_cnt:i",
    with_ctes("""SELECT session_id, s AS window_s, to_timestamp(epoch_us(ts) // (s * 1000000) * s)::TIMESTAMP AS w, beacon, avg(rssi) AS rssi_mean,
      quantile_cont(rssi, 0.5) AS rssi_median, max(rssi) AS rssi_max, var_samp(rssi) AS rssi_var, count(rssi) AS rssi_cnt
      FROM (SELECT session_id, ts, beacon, avg(rssi) AS rssi, unnest([1800, 3600, 14400]::BIGINT[]) AS s FROM rssi GROUP BY 1, 2, 3) GROUP BY 1, 2, 3, 4"""),
)
def _(spark, sf):
    return op.rssi_window_features(A.rssi_samples(spark, sf), (1800, 3600, 14400))


@query(
    "beacon_summary",
    "session_id:i beacon:s detections:i mean_rssi:f median_rssi:f min_rssi:f max_rssi:f coverage_fraction:f",
    with_ctes("""SELECT session_id, beacon, count(*) AS detections, avg(rssi) AS mean_rssi, quantile_cont(rssi, 0.5) AS median_rssi,
      min(rssi) AS min_rssi, max(rssi) AS max_rssi, count(*) / any_value(n) AS coverage_fraction
      FROM rssi JOIN (SELECT session_id, count(DISTINCT ts) AS n FROM rssi GROUP BY 1) USING (session_id) GROUP BY 1, 2"""),
)
def _(spark, sf):
    return op.beacon_summary(A.rssi_samples(spark, sf))


@query(
    "acc_window_std",
    "session_id:i w:t acc_count:i acc_std:f acc_online:b",
    with_ctes("""SELECT session_id, time_bucket(INTERVAL 6 HOUR, ts) AS w, count(*) AS acc_count,
      CASE WHEN count(*) >= 10 THEN stddev_samp(magnitude) / any_value(m) END AS acc_std, true AS acc_online
      FROM acc JOIN (SELECT session_id, quantile_cont(magnitude, 0.5) AS m FROM acc GROUP BY 1) USING (session_id) GROUP BY 1, 2"""),
)
def _(spark, sf):
    return op.acc_window_std(A.acc_samples(spark, sf), 6 * HOUR)


@query(
    "acc_window_stats",
    "session_id:i w:t acc_count:i acc_mean:g acc_std:f acc_range:f low_acc_variation:i has_acc_data:i",
    with_ctes("""SELECT session_id, w, acc_count, acc_mean, acc_std, acc_range, CAST(s12 <= q AS INT) AS low_acc_variation, 1 AS has_acc_data
      FROM a JOIN (SELECT session_id, quantile_cont(s12, 0.25) AS q FROM a GROUP BY 1) USING (session_id)""",
      a="""SELECT session_id, time_bucket(INTERVAL 2 HOUR, ts) AS w, count(*) AS acc_count, avg(magnitude) AS acc_mean,
        stddev_pop(magnitude) AS acc_std, round(stddev_pop(magnitude), 12) AS s12, max(magnitude) - min(magnitude) AS acc_range FROM acc GROUP BY 1, 2"""),
)
def _(spark, sf):
    return op.acc_window_stats(A.acc_samples(spark, sf), 2 * HOUR)


@query(
    "acc_window_clean",
    "session_id:i w:t acc_count:i clean_mean:g clean_std:f raw_max:f spike_count:i high_motion:b",
    with_ctes("""SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS acc_count, avg(c) AS clean_mean, stddev_samp(c) AS clean_std,
      max(magnitude) AS raw_max, sum(CAST(magnitude > 1.2 AS INT)) AS spike_count,
      coalesce(stddev_samp(c) >= 0.010, false) OR sum(CAST(magnitude > 1.2 AS INT)) > 0 AS high_motion
      FROM (SELECT *, CASE WHEN magnitude > 1.2 THEN 1.0 ELSE magnitude END AS c FROM acc) GROUP BY 1, 2"""),
)
def _(spark, sf):
    return op.acc_window_clean(A.acc_samples(spark, sf), HOUR)


@query("step_increments", "event_id:i session_id:i cnt:f increment:f reset:b", with_ctes("SELECT event_id, session_id, cnt, increment, reset FROM inc"))
def _(spark, sf):
    return op.step_increments(A.step_samples(spark, sf), ["event_id"])


@query(
    "step_window_agg",
    "session_id:i w:t steps_in_window:f step_samples:i step_resets:i step_count_start:f step_count_end:f steps_per_minute:f low_step_motion:i has_step_data:i",
    with_ctes("""SELECT g.session_id, g.w, coalesce(steps_in_window, 0) AS steps_in_window, coalesce(step_samples, 0) AS step_samples,
       coalesce(step_resets, 0) AS step_resets, step_count_start, step_count_end, coalesce(steps_in_window, 0) / 60.0 AS steps_per_minute,
       CAST(coalesce(steps_in_window, 0) <= coalesce(q, 0) AS INT) AS low_step_motion, CAST(coalesce(step_samples, 0) > 0 AS INT) AS has_step_data
      FROM (SELECT session_id, unnest(generate_series(min(w), max(w), INTERVAL 1 HOUR)) AS w FROM a GROUP BY 1) g LEFT JOIN a USING (session_id, w)
      LEFT JOIN (SELECT session_id, quantile_cont(steps_in_window, 0.25) AS q FROM a WHERE steps_in_window > 0 GROUP BY 1) USING (session_id)""",
      a="""SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, sum(increment) AS steps_in_window, count(cnt) AS step_samples,
       sum(CAST(reset AS INT)) AS step_resets, arg_min(cnt, (ts, event_id)) AS step_count_start, arg_max(cnt, (ts, event_id)) AS step_count_end FROM inc GROUP BY 1, 2"""),
)
def _(spark, sf):
    inc = op.step_increments(A.step_samples(spark, sf), ["event_id"])
    return op.step_window_agg(inc, HOUR, ["event_id"])


# plateaus need equal consecutive counts: count in steps of 50 here
cte(
    flat="""SELECT *, cnt - lag(cnt) OVER o AS d, lag(cnt) OVER o AS prev_cnt, lag(ts) OVER o AS prev_ts FROM
      (SELECT session_id, ts, event_id, floor(cnt / 50) * 50 AS cnt FROM steps) WINDOW o AS (PARTITION BY session_id ORDER BY ts, event_id)""",
)


@query(
    "step_zero_plateau",
    "session_id:i w:t step_increment:f samples:i reconstructed:b",
    with_ctes("""SELECT session_id, w, step_increment, samples, false AS reconstructed FROM o UNION ALL
      SELECT session_id, w, 0, 0, true FROM (SELECT DISTINCT session_id, unnest(generate_series(
          time_bucket(INTERVAL 5 MINUTE, prev_ts) + INTERVAL 5 MINUTE, time_bucket(INTERVAL 5 MINUTE, ts), INTERVAL 5 MINUTE)) AS w
        FROM flat WHERE cnt = prev_cnt AND ts > prev_ts AND ts - prev_ts <= INTERVAL 35 MINUTE) p
      WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.session_id = p.session_id AND o.w = p.w)""",
      o="""SELECT session_id, time_bucket(INTERVAL 5 MINUTE, ts) AS w, sum(greatest(coalesce(d, 0), 0)) AS step_increment, count(cnt) AS samples FROM flat GROUP BY 1, 2"""),
)
def _(spark, sf):
    s = A.step_samples(spark, sf).withColumn("cnt", F.floor(F.col("cnt") / 50) * 50.0)
    return op.step_zero_plateau(op.step_increments(s, ["event_id"]))


cte(
    adj="""SELECT session_id, ts, event_id, cnt, cnt + sum(CASE WHEN cnt < prev_cnt THEN prev_cnt ELSE 0 END)
      OVER (PARTITION BY session_id ORDER BY ts, event_id) AS adjusted_cnt FROM inc""",
)


@query("step_adjusted_cumulative", "event_id:i session_id:i cnt:f adjusted_cnt:f", with_ctes("SELECT event_id, session_id, cnt, adjusted_cnt FROM adj"))
def _(spark, sf):
    return op.step_adjusted_cumulative(A.step_samples(spark, sf), ["event_id"])


@query(
    "step_uniformise",
    "session_id:i w:t steps_in_window:f step_samples:i",
    with_ctes("""SELECT session_id, time_bucket(INTERVAL 1 HOUR, m) AS w, sum(greatest(coalesce(v - pv, 0), 0)) AS steps_in_window, count(*) AS step_samples
      FROM (SELECT *, lag(v) OVER (PARTITION BY session_id ORDER BY m) AS pv FROM (
        SELECT g.session_id, g.m, CASE WHEN b.ts IS NULL THEN a.v WHEN a.ts = b.ts THEN a.v
          ELSE a.v + (b.v - a.v) * ((epoch_us(g.m) - epoch_us(a.ts)) / (epoch_us(b.ts) - epoch_us(a.ts))) END AS v
        FROM g ASOF LEFT JOIN k a ON g.session_id = a.session_id AND g.m >= a.ts
               ASOF LEFT JOIN k b ON g.session_id = b.session_id AND g.m <= b.ts)) GROUP BY 1, 2""",
      k="SELECT session_id, ts, arg_max(adjusted_cnt, event_id) AS v FROM adj GROUP BY 1, 2",
      g="""SELECT session_id, unnest(generate_series(date_trunc('minute', min(ts)), CASE WHEN max(ts) = date_trunc('minute', max(ts)) THEN max(ts)
          ELSE date_trunc('minute', max(ts)) + INTERVAL 1 MINUTE END, INTERVAL 1 MINUTE)) AS m FROM steps GROUP BY 1"""),
)
def _(spark, sf):
    return op.step_uniformise(A.step_samples(spark, sf), HOUR, ["event_id"])


# sensors of one session start and stop at different times: one event type each
cte(
    sensw="""SELECT DISTINCT user_id AS session_id, event_type AS sensor, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events""",
)


def sensor_windows(spark, sf):
    ev = A.events(spark, sf)
    return ev.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("sensor"), timefn.floor_ts("ts", HOUR).alias("w")).distinct()


@query(
    "grid_session",
    "session_id:i w:t",
    with_ctes("SELECT session_id, unnest(generate_series(min(w), max(w), INTERVAL 1 HOUR)) AS w FROM sensw GROUP BY 1"),
)
def _(spark, sf):
    s = sensor_windows(spark, sf)
    return op.grid_session([s.filter(F.col("sensor") == t[0]) for t in A.BEACON_ROWS], HOUR)


@query(
    "grid_common",
    "pair_id:i w:t",
    with_ctes("""SELECT pair_id, unnest(generate_series(greatest(l.a, r.a), least(l.b, r.b), INTERVAL 1 HOUR)) AS w FROM
      (SELECT DISTINCT user_id // 2 AS pair_id FROM events) p
      JOIN s l ON l.session_id = pair_id * 2 JOIN s r ON r.session_id = pair_id * 2 + 1 WHERE greatest(l.a, r.a) <= least(l.b, r.b)""",
      s="SELECT user_id AS session_id, time_bucket(INTERVAL 1 HOUR, min(ts)) AS a, time_bucket(INTERVAL 1 HOUR, max(ts)) AS b FROM events GROUP BY 1"),
)
def _(spark, sf):
    s = sensor_windows(spark, sf)
    pairs = s.select(F.floor(F.col("session_id") / 2).cast("bigint").alias("pair_id")).distinct()
    pairs = pairs.withColumns({"left_session": F.col("pair_id") * 2, "right_session": F.col("pair_id") * 2 + 1})
    return op.grid_common(s, pairs, HOUR)


@query(
    "online_any",
    "session_id:i w:t wearable_online:b",
    with_ctes("""SELECT session_id, w, o.w2 IS NOT NULL AS wearable_online FROM
      (SELECT session_id, unnest(generate_series(min(w), max(w), INTERVAL 1 HOUR)) AS w FROM sensw GROUP BY 1) g
      LEFT JOIN (SELECT DISTINCT session_id AS s2, w AS w2 FROM sensw WHERE sensor IN ('error','purchase','signup')) o ON session_id = s2 AND w = w2"""),
)
def _(spark, sf):
    s = sensor_windows(spark, sf)
    grid = op.grid_session([s], HOUR)
    return op.online_any(grid, [s.filter(F.col("sensor") == k) for k in ("error", "purchase", "signup")])


@query(
    "movement_source",
    "session_id:i w:t movement_source:s movement_value:f",
    with_ctes("""SELECT session_id, w, CASE WHEN ha THEN 'acc' WHEN hs THEN 'step' ELSE 'unresolved' END AS movement_source,
       CASE WHEN ha THEN a WHEN hs THEN s END AS movement_value
      FROM m JOIN (SELECT session_id, bool_or(a IS NOT NULL) AS ha, bool_or(s IS NOT NULL) AS hs FROM m GROUP BY 1) USING (session_id)""",
      m="""SELECT user_id AS session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, max(CASE WHEN event_type = 'error' AND value > 180 THEN value END) AS a,
        max(CASE WHEN event_type = 'view' THEN floor(value) END) AS s FROM events GROUP BY 1, 2"""),
)
def _(spark, sf):
    ev = A.events(spark, sf)
    m = ev.groupBy(F.col("user_id").alias("session_id"), timefn.floor_ts("ts", HOUR).alias("w")).agg(
        F.max(F.when((F.col("event_type") == "error") & (F.col("value") > 180), F.col("value"))).alias("acc_std"),
        F.max(F.when(F.col("event_type") == "view", F.floor("value").cast("double"))).alias("step_increment"),
    )
    return op.movement_source(m)


cte(
    mwsteps="""SELECT session_id, s AS window_s, to_timestamp(epoch_us(ts) // (s * 1000000) * s)::TIMESTAMP AS w, sum(increment) AS steps, count(*) AS n
      FROM (SELECT *, unnest([1800, 3600, 14400]::BIGINT[]) AS s FROM inc) GROUP BY 1, 2, 3""",
)


def multi_window_steps(spark, sf, sizes=(1800, 3600, 14400)):
    inc = op.step_increments(A.step_samples(spark, sf), ["event_id"])
    width = F.col("window_s").cast("bigint") * 1_000_000
    start = F.timestamp_micros(F.floor(F.unix_micros("ts") / width).cast("bigint") * width)
    return (
        inc.select("*", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("window_s"))
        .groupBy("session_id", "window_s", start.alias("w"))
        .agg(F.sum("increment").alias("steps"), F.count("*").alias("n"))
    )


@query(
    "mw_align_floor",
    "session_id:i w:t steps_30m:f steps_60m:f steps_240m:f n_30m:i n_240m:i",
    with_ctes("""SELECT g.session_id, g.w, a.steps AS steps_30m, b.steps AS steps_60m, c.steps AS steps_240m, a.n AS n_30m, c.n AS n_240m FROM
      (SELECT session_id, unnest(generate_series(min(w), max(w), INTERVAL 10 MINUTE)) AS w FROM mwsteps WHERE window_s = 1800 GROUP BY 1) g
      LEFT JOIN mwsteps a ON a.session_id = g.session_id AND a.window_s = 1800 AND a.w = time_bucket(INTERVAL 30 MINUTE, g.w)
      LEFT JOIN mwsteps b ON b.session_id = g.session_id AND b.window_s = 3600 AND b.w = time_bucket(INTERVAL 1 HOUR, g.w)
      LEFT JOIN mwsteps c ON c.session_id = g.session_id AND c.window_s = 14400 AND c.w = time_bucket(INTERVAL 4 HOUR, g.w)"""),
)
def _(spark, sf):
    sized = multi_window_steps(spark, sf)
    anchors = op.window_grid(sized.filter("window_s = 1800"), 600)
    return op.align_floor(anchors, sized, (1800, 3600, 14400), ("steps", "n"))


@query(
    "features_outer",
    "session_id:i w:t strongest_rssi:f steps:f n:i acc_std:f",
    """SELECT coalesce(r.session_id, s.session_id, a.session_id) AS session_id, coalesce(r.w, s.w, a.w) AS w, strongest_rssi, coalesce(steps, 0) AS steps,
      coalesce(n, 0) AS n, acc_std FROM
      (SELECT user_id AS session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, max(-(40 + value % 50)) AS strongest_rssi FROM events WHERE event_type IN ('click','view') GROUP BY 1, 2) r
      FULL JOIN (SELECT user_id AS session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, sum(floor(value)) AS steps, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1, 2) s
        ON r.session_id = s.session_id AND r.w = s.w
      FULL JOIN (SELECT user_id AS session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, stddev_pop(value) AS acc_std FROM events WHERE event_type IN ('error','purchase') GROUP BY 1, 2) a
        ON coalesce(r.session_id, s.session_id) = a.session_id AND coalesce(r.w, s.w) = a.w""",
)
def _(spark, sf):
    ev = A.events(spark, sf).withColumn("session_id", F.col("user_id")).withColumn("w", timefn.floor_ts("ts", HOUR))
    rssi = ev.filter(F.col("event_type").isin("click", "view")).groupBy("session_id", "w").agg(F.max(-(F.lit(40) + F.col("value") % 50)).alias("strongest_rssi"))
    steps = ev.filter("event_type = 'signup'").groupBy("session_id", "w").agg(F.sum(F.floor("value").cast("double")).alias("steps"), F.count("*").alias("n"))
    acc = ev.filter(F.col("event_type").isin("error", "purchase")).groupBy("session_id", "w").agg(F.stddev_pop("value").alias("acc_std"))
    return op.features_outer(rssi, steps, acc)


cte(
    obs="SELECT DISTINCT user_id AS session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events WHERE event_type <> 'error'",
    conf="""SELECT session_id, 'out_of_home_' || CAST(row_number() OVER (PARTITION BY session_id ORDER BY w) AS VARCHAR) AS gap_id,
      w + INTERVAL 1 HOUR AS "start", nxt - INTERVAL 1 HOUR AS "end" FROM (SELECT *, lead(w) OVER (PARTITION BY session_id ORDER BY w) AS nxt FROM obs)
      WHERE nxt - w > INTERVAL 24 HOUR""",
    gaps="""SELECT g.session_id, coalesce(c.gap_id, 'long_environmental_gap_' || CAST(g.nr AS VARCHAR)) AS gap_id, gap_start, gap_end, missing_windows,
      missing_windows * 60.0 AS missing_minutes, w AS previous_observed, nxt AS next_observed, c.gap_id IS NOT NULL AS confirmed_out_of_home
      FROM (SELECT *, w + INTERVAL 1 HOUR AS gap_start, nxt - INTERVAL 1 HOUR AS gap_end, date_diff('hour', w, nxt) - 1 AS missing_windows,
        row_number() OVER (PARTITION BY session_id ORDER BY w) AS nr
        FROM (SELECT *, lead(w) OVER (PARTITION BY session_id ORDER BY w) AS nxt FROM obs) WHERE date_diff('hour', w, nxt) - 1 >= 3) g
      LEFT JOIN conf c ON c.session_id = g.session_id AND c."start" = gap_start AND c."end" = gap_end""",
)


def observed_windows(spark, sf):
    heard = F.when(F.col("event_type") != "error", F.col("value"))  # a failed scan has no level
    ev = A.events(spark, sf).withColumn("heard", heard)
    per = ev.groupBy(F.col("user_id").alias("session_id"), timefn.floor_ts("ts", HOUR).alias("w")).agg(F.count("heard").alias("n"))
    return per.filter("n > 0").select("session_id", "w")


def confirmed_gaps(observed):
    """Participant-confirmed absences: here the gaps longer than a day."""
    from pyspark.sql import Window

    order = Window.partitionBy("session_id").orderBy("w")
    long = observed.withColumn("nxt", F.lead("w").over(order)).filter(timefn.seconds_between("w", "nxt") > 24 * HOUR)
    return long.select(
        "session_id", F.concat(F.lit("out_of_home_"), F.row_number().over(order)).alias("gap_id"),
        timefn.shift_ts("w", HOUR).alias("start"), timefn.shift_ts("nxt", -HOUR).alias("end"),
    )


@query(
    "availability_gaps",
    "session_id:i gap_id:s gap_start:t gap_end:t missing_windows:i missing_minutes:f previous_observed:t next_observed:t confirmed_out_of_home:b",
    with_ctes("SELECT * FROM gaps"),
)
def _(spark, sf):
    seen = observed_windows(spark, sf)
    return op.availability_gaps(seen, HOUR, 3 * HOUR, confirmed_gaps(seen))


@query(
    "environmental_availability",
    "session_id:i w:t available:b long_gap:b confirmed_out_of_home:b",
    with_ctes("""SELECT g.session_id, g.w, o.w IS NOT NULL AS available, coalesce(p.x, false) AS long_gap, coalesce(p.c, false) AS confirmed_out_of_home
      FROM (SELECT session_id, unnest(generate_series(min(w), max(w), INTERVAL 1 HOUR)) AS w FROM obs GROUP BY 1) g
      LEFT JOIN obs o ON o.session_id = g.session_id AND o.w = g.w
      LEFT JOIN (SELECT session_id, unnest(generate_series(gap_start, gap_end, INTERVAL 1 HOUR)) AS w, true AS x, confirmed_out_of_home AS c FROM gaps) p
        ON p.session_id = g.session_id AND p.w = g.w"""),
)
def _(spark, sf):
    seen = observed_windows(spark, sf)
    return op.environmental_availability(seen, HOUR, op.availability_gaps(seen, HOUR, 3 * HOUR, confirmed_gaps(seen)))


@query(
    "availability_summary",
    "session_id:i sensor:s rows:i start_time:t end_time:t duration_hours:g median_interval_minutes:g expected_rows:i coverage_fraction:f",
    with_ctes("""SELECT *, rows / expected_rows AS coverage_fraction FROM (SELECT *, CASE WHEN median_interval_minutes > 0
        THEN floor(duration_hours * 60 / median_interval_minutes) + 1 END AS expected_rows FROM (
      SELECT session_id, sensor, count(*) AS rows, min(ts) AS start_time, max(ts) AS end_time, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 / 60 AS duration_hours,
       quantile_cont((epoch_us(ts) - epoch_us(p)) / 60000000.0, 0.5) AS median_interval_minutes FROM
      (SELECT *, lag(ts) OVER (PARTITION BY session_id, sensor ORDER BY ts, event_id) AS p FROM press) GROUP BY 1, 2))"""),
)
def _(spark, sf):
    return op.availability_summary(A.pressure_samples(spark, sf), ["event_id"])


@query(
    "availability_overlap",
    "side:s sensor:s rows:i start_time:t end_time:t duration_hours:g rows_per_hour:f common_overlap_start:t common_overlap_end:t common_overlap_hours:g common_overlap_fraction:f",
    """SELECT p.*, rows / duration_hours AS rows_per_hour, c.*, (epoch_us(common_overlap_end) - epoch_us(common_overlap_start)) / 60000000.0 / 60 AS common_overlap_hours,
       least(greatest((epoch_us(common_overlap_end) - epoch_us(common_overlap_start)) / 60000000.0 / 60 / duration_hours, 0), 1) AS common_overlap_fraction
      FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'LEFT' ELSE 'RIGHT' END AS side, event_type AS sensor, count(*) AS rows, min(ts) AS start_time, max(ts) AS end_time,
        (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 / 60 AS duration_hours FROM events GROUP BY 1, 2) p,
      (SELECT max(a) AS common_overlap_start, min(b) AS common_overlap_end FROM (SELECT min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id % 2, event_type)) c""",
)
def _(spark, sf):
    side = F.when(F.col("user_id") % 2 == 0, "LEFT").otherwise("RIGHT")
    return op.availability_overlap(A.events(spark, sf).select(side.alias("side"), F.col("event_type").alias("sensor"), "ts"))
