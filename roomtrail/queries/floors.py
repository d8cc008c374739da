"""Pressure cleaning, floors, stairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..env import durable
from ..functions import timefn
from ..operators import pressure as pr
from ..operators import stairs as st
from ..operators import topk
from ..operators import windows as win
from ..operators.intervals import join_shift_windows
from ..registry import query
from .clustering_sql import clustering_ctes
from .ctes import cte, with_ctes
from .ordering import Q, floor_shifts, observed_timeline, pressure_split, timeline, timeline_rssi

HOUR = 3600


def interp_sql(src: str, keys: str, a: str, maxr: int, v: str = "hpa") -> str:
    """Run interpolation over ``src(keys, rn, v, a)`` (oracle side)."""
    return f"""SELECT * EXCLUDE ({v}, g, len, fst, lo, hi), CASE WHEN {a} AND len <= {maxr} THEN CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo + (hi - lo) * ((rn - fst + 1) / (len + 1)) ELSE coalesce(lo, hi, {v}) END ELSE {v} END AS {v},
      {a} AND len <= {maxr} AS {a}_short, {a} AND len > {maxr} AS {a}_long FROM (SELECT *, count(*) OVER (PARTITION BY {keys}, {a}, g) AS len, min(rn) OVER (PARTITION BY {keys}, {a}, g) AS fst,
       last_value(CASE WHEN NOT {a} THEN {v} END IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo,
       first_value(CASE WHEN NOT {a} THEN {v} END IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi
      FROM (SELECT *, rn - row_number() OVER (PARTITION BY {keys}, {a} ORDER BY rn) AS g FROM {src}))"""


def spike_ctes(name: str) -> dict[str, str]:
    """Spike correction of ``{name}0`` (session_id, sensor, rn, hpa, r: out of range) as ``{name}3`` (oracle side)."""
    keys = "session_id, sensor"
    return {
        f"{name}1": interp_sql(f"{name}0", keys, "r", 2),
        f"{name}2": f"""SELECT *, hpa BETWEEN 950 AND 1050 AND round(abs(hpa - md), 9) > 1.5 AND NOT r_short AND NOT r_long AS j FROM (SELECT *, quantile_cont(hpa, 0.5) OVER (PARTITION BY {keys} ORDER BY rn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS md FROM {name}1)""",
        f"{name}3": interp_sql(f"{name}2", keys, "j", 2),
    }


cte(
    pn="""SELECT *, row_number() OVER (PARTITION BY session_id, sensor ORDER BY ts, event_id) AS rn, hpa > 1008 AS an FROM press""",
    ps0="""SELECT session_id, sensor, ts, event_id, h AS hpa, h AS raw_hpa, row_number() OVER (PARTITION BY session_id, sensor ORDER BY ts, event_id) AS rn, h NOT BETWEEN 950 AND 1050 AS r FROM (
      SELECT session_id, event_type AS sensor, ts, event_id, 1000 + value % 10 + CASE WHEN value > 150 THEN 100 ELSE 0 END AS h FROM ev)""",
    **spike_ctes("ps"),
    psp="SELECT session_id, sensor, event_id, raw_hpa, hpa, r_short OR j_short AS short_spike, r_long OR j_long AS long_spike FROM ps3",
)


@query("interp_runs", "session_id:i sensor:s event_id:i hpa:f", with_ctes("SELECT * FROM (" + interp_sql("pn", "session_id, sensor", "an", 1_000_000) + ")"))
def _(spark, sf):
    p = A.pressure_samples(spark, sf)
    return pr.interp_runs(p.withColumn("bad", F.col("hpa") > 1008), "hpa", "bad", ["session_id", "sensor"], ["event_id"])


def spiky(spark, sf):
    """Pressure with out-of-range readings where the value is large."""
    p = A.pressure_samples(spark, sf)
    ev = A.events(spark, sf).select("event_id", (F.col("value") > 150).alias("_x"))
    return p.join(ev, "event_id").withColumn("hpa", F.col("hpa") + F.when(F.col("_x"), 100).otherwise(0)).drop("_x")


@query("spike_correct", "session_id:i sensor:s event_id:i raw_hpa:f hpa:f short_spike:b long_spike:b", with_ctes("SELECT * FROM psp"))
def _(spark, sf):
    return pr.spike_correct(spiky(spark, sf), ties=["event_id"])


@query("cleaning_summary", "session_id:i sensor:s rows:i raw_missing_rows:i out_of_range_rows:i short_spike_rows:i long_spike_rows:i changed_rows:i raw_min:f raw_max:f cleaned_min:f cleaned_max:f out_of_range_fraction:f",
       with_ctes("""SELECT session_id, sensor, count(*) AS rows, 0 AS raw_missing_rows, count(*) FILTER (WHERE raw_hpa NOT BETWEEN 950 AND 1050) AS out_of_range_rows, count(*) FILTER (WHERE short_spike) AS short_spike_rows, count(*) FILTER (WHERE long_spike) AS long_spike_rows,
         count(*) FILTER (WHERE raw_hpa <> hpa) AS changed_rows, min(raw_hpa) AS raw_min, max(raw_hpa) AS raw_max, min(hpa) AS cleaned_min, max(hpa) AS cleaned_max, count(*) FILTER (WHERE raw_hpa NOT BETWEEN 950 AND 1050) / count(*) AS out_of_range_fraction FROM psp GROUP BY 1, 2"""))
def _(spark, sf):
    return pr.cleaning_summary(pr.spike_correct(spiky(spark, sf), ties=["event_id"]))


def baseline_ctes(env: str, wear: str, src: str) -> dict[str, str]:
    """Beacon baseline ``env`` of ``src(session_id, sensor, ts, hpa)`` and the wearable's rows with it, ``wear`` (oracle side)."""
    return {
        env: f"""SELECT session_id, time_bucket(INTERVAL 30 SECOND, ts) AS ts, avg(h) AS v FROM (SELECT session_id, ts, quantile_cont(hpa, 0.5) AS h FROM {src} WHERE sensor <> 'error' GROUP BY 1, 2) GROUP BY 1, 2""",
        wear: f"""SELECT w.session_id, w.ts, w.event_id, w.hpa, CASE WHEN a.ts IS NULL THEN b.v WHEN b.ts IS NULL OR a.ts = b.ts THEN a.v ELSE a.v + (b.v - a.v) * ((epoch_us(w.ts) - epoch_us(a.ts)) / (epoch_us(b.ts) - epoch_us(a.ts))) END AS baseline
          FROM (SELECT * FROM press WHERE sensor = 'error') w ASOF LEFT JOIN {env} a ON a.session_id = w.session_id AND w.ts >= a.ts ASOF LEFT JOIN {env} b ON b.session_id = w.session_id AND w.ts <= b.ts""",
    }


cte(**baseline_ctes("benv", "wbase", "press"))


@query("time_interp_baseline", "session_id:i ts:t baseline:f", with_ctes("SELECT DISTINCT session_id, ts, baseline FROM wbase"))
def _(spark, sf):
    wear, env = pressure_split(spark, sf)
    return pr.beacon_baseline(env, wear)


def blend_ctes(name: str, src: str, threshold: float, context: int, fits: str) -> dict[str, str]:
    """Offset-run correction of ``src(session_id, ts, event_id, hpa, baseline)`` as the
    building block ``name`` and what it needs (oracle side)."""
    around = lambda lo, hi: f"(SELECT quantile_cont(off, 0.5) FROM {name}_off x WHERE x.session_id = r.session_id AND NOT x.mask AND x.rn BETWEEN {lo} AND {hi})"
    return {
        f"{name}_off": f"SELECT *, hpa - baseline AS off, coalesce(round(abs(hpa - baseline), 9) > {threshold}, false) AS mask, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS rn FROM {src}",
        f"{name}_run": f"SELECT *, count(*) OVER (PARTITION BY session_id, mask, g) AS len, min(rn) OVER (PARTITION BY session_id, mask, g) AS fst FROM (SELECT *, rn - row_number() OVER (PARTITION BY session_id, mask ORDER BY rn) AS g FROM {name}_off)",
        f"{name}_ctx": f"SELECT r.session_id, r.fst, r.len, {around(f'r.fst - {context}', 'r.fst - 1')} AS b, {around('r.fst + r.len', f'r.fst + r.len + {context} - 1')} AS a FROM (SELECT DISTINCT session_id, fst, len FROM {name}_run WHERE mask AND {fits}) r",
        name: f"""SELECT d.session_id, d.ts, d.event_id, d.baseline, CASE WHEN c.bo IS NOT NULL THEN baseline + bo + (ao - bo) * ((d.rn - c.fst + 1) / (c.len + 1)) ELSE hpa END AS hpa, c.bo IS NOT NULL AS corrected
          FROM {name}_run d LEFT JOIN (SELECT session_id, fst, len, coalesce(b, a) AS bo, coalesce(a, b) AS ao FROM {name}_ctx) c ON d.mask AND c.session_id = d.session_id AND d.rn >= c.fst AND d.rn < c.fst + c.len""",
    }


CLEAN = pr.CleaningParams(plateau_hpa=2.5, plateau_min_rows=3, context_rows=10, residual_hpa=1.2, residual_max_rows=2)


def with_baseline(spark, sf):
    wear, env = pressure_split(spark, sf)
    wear = wear.select("session_id", "ts", "event_id", "hpa")
    return durable(wear.join(pr.beacon_baseline(env, wear), ["session_id", "ts"]))


@query("plateau_correct", "session_id:i event_id:i hpa:f corrected:b", with_ctes("SELECT * FROM plateaus", **blend_ctes("plateaus", "wbase", 2.5, 10, "len >= 3")))
def _(spark, sf):
    return pr.plateau_correct(with_baseline(spark, sf), ["event_id"], CLEAN)


@query("residual_correct", "session_id:i event_id:i hpa:f corrected:b", with_ctes("SELECT * FROM residuals", **blend_ctes("residuals", "wbase", 1.2, 10, "len <= 2")))
def _(spark, sf):
    return pr.residual_correct(with_baseline(spark, sf), ["event_id"], CLEAN)


@query("pressure_chain", "session_id:i event_id:i hpa:f baseline:f relative:f relative_smooth:f",
       with_ctes("""SELECT session_id, event_id, hpa, baseline, hpa - baseline AS relative, quantile_cont(hpa - baseline, 0.5) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS relative_smooth FROM chain_b""",
                 chain0="SELECT session_id, sensor, ts, event_id, hpa, row_number() OVER (PARTITION BY session_id, sensor ORDER BY ts, event_id) AS rn, hpa NOT BETWEEN 950 AND 1050 AS r FROM press WHERE sensor <> 'error'",
                 **spike_ctes("chain"), **baseline_ctes("chain_env", "chain_wear", "chain3"), **blend_ctes("chain_a", "chain_wear", 2.5, 10, "len >= 3"), **blend_ctes("chain_b", "chain_a", 1.2, 10, "len <= 2")))
def _(spark, sf):
    wear, env = pressure_split(spark, sf)
    return pr.pressure_chain(wear.select("session_id", "ts", "event_id", "hpa"), env, ["event_id"], CLEAN)[1]


@query("pairwise_pressure", "session_id:i sensor_a:s sensor_b:s difference:f",
       with_ctes("SELECT a.session_id, a.sensor AS sensor_a, b.sensor AS sensor_b, a.m - b.m AS difference FROM pm a JOIN pm b USING (session_id)", pm="SELECT session_id, sensor, quantile_cont(hpa, 0.5) AS m FROM press GROUP BY 1, 2"))
def _(spark, sf):
    return pr.pairwise_pressure(A.pressure_samples(spark, sf))


cte(
    fgd="SELECT session_id, w, floor, quantile_cont(diff, 0.5) AS group_diff FROM pdiff JOIN beacons ON beacon = sensor GROUP BY 1, 2, 3",
    bline="SELECT session_id, quantile_cont(diff, 0.5) AS b FROM pdiff GROUP BY 1",
)


def diffs(spark, sf):
    return durable(topk.pressure_differences(*pressure_split(spark, sf), HOUR))


def sensor_floors(spark):
    return A.beacons(spark).select(F.col("beacon").alias("sensor"), "floor")


@query("floor_group_diff", "session_id:i w:t floor:s group_diff:f", with_ctes("SELECT * FROM fgd"))
def _(spark, sf):
    return pr.floor_group_diff(diffs(spark, sf), sensor_floors(spark))


@query("same_floor_baseline", "session_id:i same_floor_baseline:f other_floor_center:f same_floor_height_m:f nearest_median:f nearest_mean:f nearest_mad:f nearest_p05:f nearest_p95:f ci_low:f ci_high:f floor_gap_hpa:f floor_height_m:f nearest_samples:i")
def _(spark, sf):
    return pr.same_floor_baseline(pr.floor_group_diff(diffs(spark, sf), sensor_floors(spark)))


def median_baseline(d):
    return d.groupBy("session_id").agg(F.percentile("diff", F.lit(0.5)).alias("same_floor_baseline"))


@query("baseline_adjust", "session_id:i w:t closest_beacon:s closest_abs_diff:f signed_sum:f signed_mean:f",
       with_ctes("""SELECT session_id, w, arg_min(sensor, (round(abs(diff - b), 9), sensor)) AS closest_beacon, min(abs(diff - b)) AS closest_abs_diff, sum(diff) AS signed_sum, avg(diff) AS signed_mean FROM pdiff JOIN bline USING (session_id) GROUP BY 1, 2"""))
def _(spark, sf):
    d = diffs(spark, sf)
    return pr.baseline_adjust(d, median_baseline(d))


cte(
    fltop="""SELECT session_id, w, max(CASE WHEN r = 1 THEN floor END) AS floor, max(CASE WHEN r = 1 THEN d END) AS distance, max(CASE WHEN r = 2 THEN d END) - max(CASE WHEN r = 1 THEN d END) AS margin FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id, w ORDER BY d, floor) AS r FROM (SELECT session_id, w, floor, round(abs(group_diff - b), 12) AS d FROM fgd JOIN bline USING (session_id))) GROUP BY 1, 2""",
    flgrid="""SELECT *, floor IS DISTINCT FROM lag(floor) OVER o OR row_number() OVER o = 1 AS new FROM (SELECT g.session_id, g.w, t.w IS NOT NULL AS available, t.floor, t.distance, t.margin FROM (
      SELECT session_id, unnest(generate_series(min(w), max(w), INTERVAL 1 HOUR)) AS w FROM fltop GROUP BY 1) g LEFT JOIN fltop t ON t.session_id = g.session_id AND t.w = g.w) WINDOW o AS (PARTITION BY session_id ORDER BY w)""",
    flisl="SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY session_id ORDER BY w) AS isl FROM flgrid",
    flrun="SELECT *, lead(v) OVER (PARTITION BY session_id ORDER BY isl) AS after FROM (SELECT session_id, isl, any_value(floor) AS v, count(*) AS n FROM flisl GROUP BY 1, 2)",
    flwalk="""WITH RECURSIVE r AS (SELECT session_id, isl, v FROM flrun WHERE isl = 1
      UNION ALL SELECT n.session_id, n.isl, CASE WHEN n.n <= 2 AND n.v IS NOT NULL AND r.v = n.after AND r.v <> n.v THEN r.v ELSE n.v END FROM r JOIN flrun n ON n.session_id = r.session_id AND n.isl = r.isl + 1) SELECT * FROM r""",
)


@query("floor_timeline", "session_id:i w:t floor:s distance:f margin:f confidence:f smoothed:s floor_observed:b",
       with_ctes("""SELECT session_id, w, floor, distance, margin, CASE WHEN margin IS NOT NULL THEN least(greatest(margin / 0.20, 0), 1) END AS confidence, CASE WHEN available THEN v END AS smoothed, available AND v IS NOT NULL AS floor_observed
         FROM flisl JOIN flwalk USING (session_id, isl)"""))
def _(spark, sf):
    d = diffs(spark, sf)
    seen = d.select("session_id", "w").distinct()
    grid = win.environmental_availability(seen, HOUR, win.availability_gaps(seen, HOUR, 3 * HOUR))
    return pr.floor_timeline(grid.select("session_id", "w", "available"), pr.floor_group_diff(d, sensor_floors(spark)), median_baseline(d))


def hourly_pressure(spark, sf):
    p = A.pressure_samples(spark, sf)
    return p.groupBy("session_id", timefn.floor_ts("ts", HOUR).alias("w"), "sensor").agg(F.avg("hpa").alias("hpa"))


cte(
    hp="SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, sensor, avg(hpa) AS hpa FROM press GROUP BY 1, 2, 3",
    gpr="SELECT session_id, w, floor, quantile_cont(hpa, 0.5) AS gp FROM hp JOIN beacons ON beacon = sensor WHERE sensor <> 'error' GROUP BY 1, 2, 3",
    calo="""SELECT session_id, quantile_cont(h.hpa - g.gp, 0.5) AS o, count(*) AS pairs FROM (SELECT session_id, w, strongest_beacon AS beacon FROM rtop) r JOIN (SELECT * FROM beacons WHERE beacon <> 'error') b USING (beacon)
      JOIN gpr g USING (session_id, w, floor) JOIN (SELECT * FROM hp WHERE sensor = 'error') h USING (session_id, w) GROUP BY 1""",
    pinf="""SELECT *, coalesce(round(confidence, 12) >= 0.75, false) AND (NOT coalesce(fl <> pf, false) OR near) AS trusted FROM (SELECT g.session_id, g.w, t.fl, t.confidence, lag(t.fl) OVER o AS pf, e.w IS NOT NULL AS env,
        bool_or(coalesce(m.mv, false)) OVER (PARTITION BY g.session_id ORDER BY g.w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near
       FROM hgrid g LEFT JOIN (SELECT session_id, w, max(CASE WHEN r = 1 THEN floor END) AS fl, (max(CASE WHEN r = 2 THEN d END) - max(CASE WHEN r = 1 THEN d END)) / (max(CASE WHEN r = 2 THEN d END) + 0.05) AS confidence FROM (
          SELECT g.session_id, g.w, g.floor, round(abs(g.gp - (h.hpa - c.o)), 12) AS d, row_number() OVER (PARTITION BY g.session_id, g.w ORDER BY round(abs(g.gp - (h.hpa - c.o)), 12), g.floor) AS r
          FROM gpr g JOIN (SELECT * FROM hp WHERE sensor = 'error') h USING (session_id, w) JOIN calo c USING (session_id)) GROUP BY 1, 2) t USING (session_id, w)
       LEFT JOIN (SELECT DISTINCT session_id, w FROM hp WHERE sensor <> 'error') e USING (session_id, w)
       LEFT JOIN (SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, round(avg(value), 6) > 60 AS mv FROM ev GROUP BY 1, 2) m USING (session_id, w) WINDOW o AS (PARTITION BY g.session_id ORDER BY g.w))""",
)


# offsets of the beacons from the median of their window, their ordered clusters, and each candidate's checks
cte(
    agm="SELECT session_id, w, quantile_cont(hpa, 0.5) AS med FROM hp GROUP BY 1, 2 HAVING count(*) >= 2",
    ago="SELECT b.session_id, b.beacons, coalesce(o.n, 0) AS overlap_windows FROM (SELECT session_id, count(DISTINCT sensor) AS beacons FROM hp GROUP BY 1) b LEFT JOIN (SELECT session_id, count(*) AS n FROM agm GROUP BY 1) o USING (session_id)",
    agx="SELECT session_id, sensor, quantile_cont(hpa - med, 0.5) AS x FROM hp JOIN agm USING (session_id, w) JOIN (SELECT session_id FROM ago WHERE overlap_windows >= 100 AND beacons >= 4) USING (session_id) GROUP BY 1, 2",
)
clustering_ctes("ag", "SELECT session_id, x FROM agx", (2, 3))
cte(
    agmad="""SELECT session_id, k, greatest(quantile_cont(mad, 0.5), 1e-6) AS pooled_mad FROM (SELECT session_id, k, label, quantile_cont(abs(x - m), 0.5) AS mad FROM (
      SELECT l.session_id, l.k, l.label, o.x, quantile_cont(o.x, 0.5) OVER (PARTITION BY l.session_id, l.k, l.label) AS m FROM ag_lab l JOIN agx o ON o.session_id = l.session_id AND o.x = l.x) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    agc="""SELECT *, len(fails) = 0 AS valid FROM (SELECT *, list_filter([CASE WHEN round(silhouette, 12) < 0.75 THEN 'silhouette' END, CASE WHEN separation < 0.30 THEN 'floor_scale_separation' END, CASE WHEN smallest < 2 THEN 'group_size' END,
       CASE WHEN separation < 3 * pooled_mad THEN 'within_group_dispersion' END], lambda f: f IS NOT NULL) AS fails FROM (
      SELECT session_id, k, min(n) AS smallest, sum(n) AS rows, round(min(c - before), 12) AS separation FROM (SELECT *, lag(c) OVER (PARTITION BY session_id, k ORDER BY label) AS before FROM ag_cen) GROUP BY 1, 2)
      JOIN ag_sil USING (session_id, k) JOIN agmad USING (session_id, k) WHERE rows >= 2 * k)""",
)


@query("auto_floor_groups", "session_id:i overlap_windows:i beacons:i floor_k:i groups_valid:b reason:s silhouette:f min_separation:f pooled_mad:f",
       with_ctes("""SELECT o.session_id, o.overlap_windows, o.beacons, coalesce(p.chosen, 1) AS floor_k, p.chosen IS NOT NULL AS groups_valid, c.silhouette, c.separation AS min_separation, c.pooled_mad,
         CASE WHEN p.chosen IS NOT NULL THEN 'stable_multifloor_grouping' WHEN o.overlap_windows < 100 OR o.beacons < 4 THEN 'insufficient_overlap_or_beacons' WHEN p.session_id IS NULL THEN 'k1_null_selected_no_valid_candidate'
          ELSE 'k1_null_selected_' || array_to_string(c.fails, '_and_') END AS reason
         FROM ago o LEFT JOIN (SELECT *, CASE WHEN v2 AND v3 THEN CASE WHEN s3 >= s2 + 0.05 THEN 3 ELSE 2 END WHEN v2 THEN 2 WHEN v3 THEN 3 END AS chosen, CASE WHEN s3 IS NULL OR s2 >= s3 THEN 2 ELSE 3 END AS best FROM (
           SELECT session_id, coalesce(bool_or(valid) FILTER (WHERE k = 2), false) AS v2, coalesce(bool_or(valid) FILTER (WHERE k = 3), false) AS v3, max(silhouette) FILTER (WHERE k = 2) AS s2, max(silhouette) FILTER (WHERE k = 3) AS s3 FROM agc GROUP BY 1)) p USING (session_id)
         LEFT JOIN agc c ON c.session_id = o.session_id AND c.k = coalesce(p.chosen, p.best)"""))
def _(spark, sf):
    return pr.auto_floor_groups(hourly_pressure(spark, sf))[1]


def constrained(spark, sf):
    cells = durable(win.rssi_window_agg(A.rssi_samples(spark, sf), HOUR))
    hp = durable(hourly_pressure(spark, sf))
    mv = A.events(spark, sf).groupBy("session_id", timefn.floor_ts("ts", HOUR).alias("w")).agg((F.round(F.avg("value"), 6) > 60).alias("moving"))
    sess = cells.select("session_id").distinct().withColumn("_o", F.lit(1))
    groups = sess.join(F.broadcast(sensor_floors(spark).filter("sensor <> 'error'").withColumn("_o", F.lit(1))), "_o").drop("_o")
    wear = hp.filter("sensor = 'error'").select("session_id", "w", "hpa")
    return pr.pressure_constraint(win.window_grid(cells, HOUR), cells, hp.filter("sensor <> 'error'"), wear, groups, mv)


@query("pressure_constraint", "session_id:i w:t beacon:s rssi_mean:f",
       with_ctes("""SELECT session_id, w, beacon, CASE WHEN fl IS NOT NULL AND heard AND NOT mine THEN NULL ELSE rssi_mean END AS rssi_mean FROM (SELECT r.session_id, r.w, r.beacon, r.rssi_mean, i.fl, coalesce(b.floor = i.fl, false) AS mine,
         bool_or(coalesce(b.floor = i.fl, false)) OVER (PARTITION BY r.session_id, r.w) AS heard FROM rw r LEFT JOIN (SELECT * FROM pinf WHERE trusted) i USING (session_id, w) LEFT JOIN (SELECT * FROM beacons WHERE beacon <> 'error') b USING (beacon))"""))
def _(spark, sf):
    return constrained(spark, sf)[0]


@query("pressure_constraint_status", "session_id:i w:t pressure_floor_group:s pressure_floor_confidence:f pressure_floor_trusted:b pressure_status:s",
       with_ctes("""SELECT session_id, w, fl AS pressure_floor_group, confidence AS pressure_floor_confidence, trusted AS pressure_floor_trusted,
         CASE WHEN trusted THEN 'trusted_same_floor_constraint' WHEN confidence IS NOT NULL THEN 'low_confidence_kept_raw' WHEN env THEN 'environmental_pressure_only' ELSE 'inactive' END AS pressure_status FROM pinf"""))
def _(spark, sf):
    return constrained(spark, sf)[1]


# pressure floor by value, so that all branches occur
cte(
    faw="""SELECT t.session_id, t.w, t.beacon AS strongest_beacon, t.floor AS beacon_floor, CASE WHEN t.av < 40 THEN '1F' WHEN t.av < 120 THEN '2F' END AS pf, CASE WHEN t.mx < 200 THEN least(t.mx / 100, 1) END AS confidence,
       sw.near_supported_shift AS ns, sw.near_unsupported_shift AS nu FROM otl t JOIN (SELECT t.session_id, t.w, coalesce(bool_or(s.supported), false) AS near_supported_shift, coalesce(bool_or(NOT s.supported), false) AS near_unsupported_shift
        FROM otl t LEFT JOIN shifts s ON s.session_id = t.session_id AND t.w BETWEEN s.support_start AND s.support_end GROUP BY 1, 2) sw USING (session_id, w) WHERE t.beacon IS NOT NULL""",
    fab="""SELECT *, CASE WHEN NOT consistent AND trusted AND sb IS NOT NULL THEN sb ELSE strongest_beacon END AS aware_beacon, CASE WHEN NOT consistent AND sb IS NOT NULL THEN sb ELSE strongest_beacon END AS brute_beacon FROM (
      SELECT f.*, coalesce(beacon_floor = pf, false) AS consistent, coalesce(confidence >= 0.75, false) AND NOT nu AS trusted, s.b AS sb FROM faw f LEFT JOIN (
       SELECT r.session_id, r.w, arg_min(r.beacon, (-r.rssi_mean, r.beacon)) AS b FROM tlrs r JOIN beacons b USING (beacon) JOIN faw f ON f.session_id = r.session_id AND f.w = r.w AND f.pf = b.floor GROUP BY 1, 2) s USING (session_id, w))""",
    fac="""SELECT *, aware_beacon <> strongest_beacon AS aware_changed, brute_beacon <> strongest_beacon AS brute_changed, NOT consistent AND sb IS NULL AS brute_no_candidate,
      CASE WHEN consistent THEN 'floor_consistent' WHEN confidence < 0.75 THEN 'pressure_uncertain' WHEN nu THEN 'acc_unsupported_floor_shift' WHEN ns THEN 'possible_cross_floor_transition' WHEN confidence >= 0.75 THEN 'floor_conflict' ELSE 'insufficient_floor_or_rssi' END AS status,
      CASE WHEN aware_beacon <> strongest_beacon THEN 'switched_to_best_same_floor_beacon' WHEN consistent THEN 'raw_rssi_already_same_floor' WHEN nu THEN 'kept_raw_due_to_acc_unsupported_shift' WHEN confidence < 0.75 THEN 'kept_raw_due_to_low_pressure_confidence' ELSE 'kept_raw_no_same_floor_switch' END AS change_reason FROM fab""",
)


def aware(spark, sf):
    t = join_shift_windows(durable(observed_timeline(spark, sf)), floor_shifts(spark, sf), Q).filter("beacon is not null")
    w = t.select(
        "session_id", "w", F.col("beacon").alias("strongest_beacon"), F.when(F.col("av") < 40, "1F").when(F.col("av") < 120, "2F").alias("pressure_floor"),
        F.when(F.col("mx") < 200, F.least(F.col("mx") / 100, F.lit(1.0))).alias("confidence"), "near_supported_shift", "near_unsupported_shift",
    )
    return pr.floor_aware_rssi(durable(w), timeline_rssi(spark, sf), A.beacons(spark).select("beacon", "floor"))


@query("floor_aware_rssi", "session_id:i w:t strongest_beacon:s beacon_floor:s consistent:b trusted:b status:s aware_beacon:s aware_changed:b change_reason:s brute_beacon:s brute_changed:b brute_no_candidate:b confidence_factor:f",
       with_ctes("""SELECT *, CASE status WHEN 'floor_consistent' THEN 1.0 WHEN 'pressure_uncertain' THEN 0.8 WHEN 'possible_cross_floor_transition' THEN 0.75 WHEN 'acc_unsupported_floor_shift' THEN 0.55 ELSE 0.5 END AS confidence_factor FROM fac"""))
def _(spark, sf):
    return aware(spark, sf)


@query("switch_summary", "session_id:i metric:s count:i percentage:f",
       with_ctes("""SELECT session_id, metric, count, CASE WHEN per > 0 THEN 100.0 * count / per ELSE 0 END AS percentage FROM (
         SELECT session_id, 'total_5min_windows' AS metric, t AS count, t AS per FROM b UNION ALL SELECT session_id, 'raw_strongest_rssi_pressure_floor_mismatch', mm, t FROM b UNION ALL SELECT session_id, 'pressure_acc_floor_trusted_windows', tr, t FROM b
         UNION ALL SELECT session_id, 'changed_to_best_same_floor_beacon', ch, t FROM b UNION ALL SELECT session_id, 'changed_as_percentage_of_mismatches', ch, mm FROM b UNION ALL SELECT session_id, 'bruteforce_changed_to_best_same_floor_beacon', bc, t FROM b
         UNION ALL SELECT session_id, 'bruteforce_changed_as_percentage_of_mismatches', bc, mm FROM b UNION ALL SELECT session_id, 'mismatch_with_no_same_floor_rssi_candidate', nc, mm FROM b
         UNION ALL SELECT f.session_id, 'change_reason__' || change_reason, count(*), any_value(b.t) FROM fac f JOIN b USING (session_id) GROUP BY 1, 2)""",
                 b="""SELECT session_id, count(*) AS t, count(*) FILTER (WHERE NOT consistent) AS mm, count(*) FILTER (WHERE trusted) AS tr, count(*) FILTER (WHERE aware_changed) AS ch, count(*) FILTER (WHERE brute_changed) AS bc, count(*) FILTER (WHERE brute_no_candidate) AS nc FROM fac GROUP BY 1"""))
def _(spark, sf):
    return pr.switch_summary(aware(spark, sf))


# -- stairs --------------------------------------------------------------------
cte(
    ste="""SELECT s.*, CASE WHEN previous_floor = '1F' AND current_floor = '2F' THEN 'ascent' WHEN previous_floor = '2F' AND current_floor = '1F' THEN 'descent' ELSE 'unknown' END AS stair_direction,
       coalesce(a.a, shift_time - INTERVAL 15 MINUTE) AS event_start, coalesce(a.b + INTERVAL 15 MINUTE, shift_time) AS event_end, greatest(date_diff('minute', coalesce(a.a, shift_time - INTERVAL 15 MINUTE), coalesce(a.b + INTERVAL 15 MINUTE, shift_time)), 15) AS duration_min,
       coalesce(a.h, 0) AS high_windows, coalesce(a.n, 0) AS support_windows, date_diff('minute', support_start, support_end) AS support_window_min
      FROM shifts s LEFT JOIN (SELECT s.session_id, s.shift_time, min(CASE WHEN t.motion OR t.spikes > 0 THEN t.w END) AS a, max(CASE WHEN t.motion OR t.spikes > 0 THEN t.w END) AS b, count(*) FILTER (WHERE t.motion OR t.spikes > 0) AS h, count(*) AS n
        FROM shifts s JOIN otl t ON t.session_id = s.session_id AND t.w BETWEEN greatest(s.support_start, s.shift_time - INTERVAL 15 MINUTE) AND least(s.support_end, s.shift_time + INTERVAL 15 MINUTE) GROUP BY 1, 2) a USING (session_id, shift_time)""",
)


def stairs(spark, sf):
    t = durable(observed_timeline(spark, sf))
    from ..operators import runs

    sh = runs.floor_shift_support(t, Q, score="av", raw_max="mx", spikes="spikes", min_score=60)
    acc = t.select("session_id", "w", F.col("motion").alias("high_motion"), F.col("spikes").alias("spike_count"))
    return st.stair_events(sh, acc, Q, reach_s=Q, too_long_min=40, window_too_long_min=45)


@query("stair_events", "session_id:i shift_time:t stair_direction:s event_start:t event_end:t duration_min:f high_windows:i support_windows:i support_window_min:f duration_too_long:b window_too_long:b any_anomaly:b",
       with_ctes("SELECT *, duration_min > 40 AS duration_too_long, support_window_min > 45 AS window_too_long, duration_min > 40 OR support_window_min > 45 AS any_anomaly FROM ste"))
def _(spark, sf):
    return stairs(spark, sf)


@query("stair_daily", "session_id:i day:d observed_hours:f stair_events:i ascents:i descents:i supported_events:i unsupported_events:i mean_ascent_min:f mean_descent_min:f median_min:f events_per_hour:f",
       with_ctes("""SELECT h.session_id, h.day, h.observed_hours, coalesce(n, 0) AS stair_events, coalesce(up, 0) AS ascents, coalesce(dn, 0) AS descents, coalesce(su, 0) AS supported_events, coalesce(us, 0) AS unsupported_events, mean_ascent_min, mean_descent_min, median_min, coalesce(n, 0) / h.observed_hours AS events_per_hour
         FROM (SELECT session_id, CAST(w + INTERVAL 9 HOUR AS DATE) AS day, count(*) * 0.25 AS observed_hours FROM otl WHERE floor IS NOT NULL GROUP BY 1, 2) h LEFT JOIN (SELECT session_id, CAST(shift_time + INTERVAL 9 HOUR AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE stair_direction = 'ascent') AS up,
          count(*) FILTER (WHERE stair_direction = 'descent') AS dn, count(*) FILTER (WHERE supported) AS su, count(*) FILTER (WHERE NOT supported) AS us, avg(duration_min) FILTER (WHERE stair_direction = 'ascent') AS mean_ascent_min,
          avg(duration_min) FILTER (WHERE stair_direction = 'descent') AS mean_descent_min, quantile_cont(duration_min, 0.5) AS median_min FROM ste GROUP BY 1, 2) e USING (session_id, day)"""))
def _(spark, sf):
    seen = observed_timeline(spark, sf).filter("floor is not null").select("session_id", "w")
    return st.stair_daily(stairs(spark, sf), seen, Q, "Asia/Tokyo")


cte(
    rseg="""SELECT s.session_id, s.shift_time, s.stair_direction, p.ts, p.event_id, p.hpa - 1005 AS v, row_number() OVER (PARTITION BY s.session_id, s.shift_time ORDER BY p.ts, p.event_id) AS i, row_number() OVER (PARTITION BY s.session_id, s.shift_time ORDER BY p.ts DESC, p.event_id DESC) AS j
      FROM ste s JOIN press p ON p.session_id = s.session_id AND p.ts BETWEEN s.shift_time - INTERVAL 2 HOUR AND s.shift_time + INTERVAL 2 HOUR""",
    rlev="""SELECT *, round(after_level - before_level, 9) AS delta FROM (SELECT session_id, shift_time, coalesce(quantile_cont(v, 0.5) FILTER (WHERE ts <= shift_time - INTERVAL 40 MINUTE), quantile_cont(v, 0.5) FILTER (WHERE i <= 4)) AS before_level,
      coalesce(quantile_cont(v, 0.5) FILTER (WHERE ts >= shift_time + INTERVAL 40 MINUTE), quantile_cont(v, 0.5) FILTER (WHERE j <= 4)) AS after_level FROM rseg GROUP BY 1, 2)""",
    rmp="""SELECT session_id, shift_time, stair_direction, before_level, after_level, delta, CASE WHEN ok THEN a END AS ramp_start, CASE WHEN ok THEN b END AS ramp_end, CASE WHEN ok THEN (epoch_us(b) - epoch_us(a)) / 60000000.0 END AS ramp_minutes,
       CASE WHEN before_level IS NULL AND after_level IS NULL THEN 'no_pressure_samples_in_local_window' WHEN delta IS NULL OR abs(delta) < 0.5 THEN 'pressure_delta_too_small_for_refined_duration' WHEN ok THEN 'pressure_10_to_90_percent_ramp' ELSE 'pressure_ramp_thresholds_not_crossed' END AS method,
       coalesce(delta * CASE stair_direction WHEN 'ascent' THEN -1 WHEN 'descent' THEN 1 ELSE 0 END > 0, false) AS sign_matches FROM (
      SELECT s.session_id, s.shift_time, s.stair_direction, l.before_level, l.after_level, l.delta, m.a, m.b, m.a IS NOT NULL AND m.b IS NOT NULL AS ok FROM ste s LEFT JOIN rlev l USING (session_id, shift_time) LEFT JOIN (
       SELECT session_id, shift_time, min(CASE WHEN m >= 0.1 THEN ts END) AS a, min(CASE WHEN m >= 0.9 THEN ts END) AS b FROM (SELECT r.session_id, r.shift_time, r.ts, max(round((v - before_level) / delta, 9)) OVER (PARTITION BY r.session_id, r.shift_time ORDER BY r.i ROWS UNBOUNDED PRECEDING) AS m
        FROM rseg r JOIN rlev l USING (session_id, shift_time) WHERE abs(delta) >= 0.5) GROUP BY 1, 2) m USING (session_id, shift_time))""",
    rfn="""SELECT r.*, coalesce(a.n, 0) AS acc_samples, a.sd AS acc_std, a.mx AS acc_max, a.dv AS acc_max_deviation, coalesce(a.sp, 0) AS spike_count, coalesce(a.sd >= 0.01, false) OR coalesce(round(a.dv, 9) >= 0.03, false) OR coalesce(a.sp, 0) > 0 AS acc_supports, coalesce(ramp_minutes > 60, false) AS too_long
      FROM rmp r LEFT JOIN (SELECT r.session_id, r.shift_time, count(*) AS n, stddev_samp(c) AS sd, max(magnitude) AS mx, max(abs(c - 1)) AS dv, sum(CAST(magnitude > 1.2 AS INT)) AS sp FROM rmp r JOIN (SELECT *, CASE WHEN magnitude > 1.2 THEN 1.0 ELSE magnitude END AS c FROM acc) x
        ON x.session_id = r.session_id AND x.ts BETWEEN r.ramp_start AND r.ramp_end GROUP BY 1, 2) a USING (session_id, shift_time)""",
)


def ramps(spark, sf):
    p = A.pressure_samples(spark, sf).select("session_id", "ts", "event_id", (F.col("hpa") - 1005).alias("relative_smooth"))
    return st.ramp_progress(durable(stairs(spark, sf)), p, local_s=2 * HOUR, level_s=2400, min_delta=0.5, ties=("event_id",))


@query("ramp_progress", "session_id:i shift_time:t before_level:f after_level:f ramp_start:t ramp_end:t ramp_minutes:g method:s sign_matches:b", with_ctes("SELECT * FROM rmp"))
def _(spark, sf):
    return ramps(spark, sf)


def refined(spark, sf):
    return st.stair_refine(durable(ramps(spark, sf)), A.acc_samples(spark, sf), max_minutes=60, bin_s=HOUR)


@query("stair_refine", "session_id:i shift_time:t ramp_minutes:g acc_samples:i acc_std:f acc_max:f acc_max_deviation:f spike_count:i acc_supports:b too_long:b", with_ctes("SELECT * FROM rfn"))
def _(spark, sf):
    return refined(spark, sf)


@query("stair_refine_summary", "session_id:i stair_direction:s events:i median_min:g mean_min:f min_min:g max_min:g acc_supported:i too_long:i",
       with_ctes("""SELECT session_id, coalesce(stair_direction, 'all') AS stair_direction, count(*) AS events, quantile_cont(ramp_minutes, 0.5) AS median_min, avg(ramp_minutes) AS mean_min, min(ramp_minutes) AS min_min, max(ramp_minutes) AS max_min,
         count(*) FILTER (WHERE acc_supports) AS acc_supported, count(*) FILTER (WHERE too_long) AS too_long FROM rfn WHERE ramp_minutes IS NOT NULL GROUP BY GROUPING SETS ((session_id, stair_direction), (session_id))"""))
def _(spark, sf):
    return st.stair_refine_summary(refined(spark, sf))
