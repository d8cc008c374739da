"""Column functions and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import rooms, signal, timefn
from ..operators import filters, windows
from ..registry import query
from .ctes import cte, with_ctes

# one raw text per user group: aliases, embedded names, unknowns, other names
RAW_ROOM = """CASE user_id % 11 WHEN 0 THEN 'living room' WHEN 1 THEN ' OUTSIDE ' WHEN 2 THEN 'my KITCHEN 2'
 WHEN 3 THEN '?' WHEN 4 THEN '' WHEN 5 THEN CAST(NULL AS {s}) WHEN 6 THEN 'garden shed' WHEN 7 THEN 'Bed Room'
 WHEN 8 THEN 'Office and dining' WHEN 9 THEN 'away' ELSE event_type END"""

NORMALISE_SQL = """CASE WHEN t IS NULL OR trim(t) = '' THEN 'Unknown'
 WHEN lower(trim(t)) IN ('out','outside','away') THEN 'Out'
 WHEN lower(trim(t)) = 'living room' THEN 'Living' WHEN lower(trim(t)) = 'bed room' THEN 'Bedroom'
 WHEN contains(lower(t),'bedroom') THEN 'Bedroom' WHEN contains(lower(t),'living') THEN 'Living'
 WHEN contains(lower(t),'dining') THEN 'Dining' WHEN contains(lower(t),'kitchen') THEN 'Kitchen'
 WHEN contains(lower(t),'bathroom') THEN 'Bathroom' WHEN contains(lower(t),'toilet') THEN 'Toilet'
 WHEN contains(lower(t),'office') THEN 'Office'
 WHEN lower(trim(t)) IN ('?','unknown','nan','none','unmapped') THEN 'Unknown'
 ELSE upper(substr(trim(t),1,1)) || substr(trim(t),2) END"""


@query(
    "fn_epoch_ts",
    "event_id:i ts_parsed:t",
    """SELECT event_id, CASE WHEN x >= 1e11 THEN make_timestamp(CAST(round(x * 1000) AS BIGINT))
         WHEN x IS NOT NULL THEN make_timestamp(CAST(round(x * 1000000) AS BIGINT)) END AS ts_parsed
       FROM (SELECT event_id, TRY_CAST(CASE user_id % 3 WHEN 0 THEN CAST(epoch_us(ts) // 1000 AS VARCHAR)
         WHEN 1 THEN CAST(epoch_us(ts) // 1000000 AS VARCHAR) ELSE 'bad' || event_type END AS DOUBLE) AS x FROM events)""",
)
def _(spark, sf):
    ev = A.events(spark, sf)
    ms = F.floor(F.unix_micros("ts") / 1000).cast("bigint").cast("string")
    sec = F.floor(F.unix_micros("ts") / 1_000_000).cast("bigint").cast("string")
    group = F.col("user_id") % 3
    text = F.when(group == 0, ms).when(group == 1, sec).otherwise(F.concat(F.lit("bad"), "event_type"))
    return ev.select("event_id", timefn.epoch_ts(text).alias("ts_parsed"))


@query(
    "fn_normalise_room",
    "event_id:i room:s",
    f"SELECT event_id, {NORMALISE_SQL} AS room FROM (SELECT event_id, {RAW_ROOM.format(s='VARCHAR')} AS t FROM events)",
)
def _(spark, sf):
    return A.events(spark, sf).select("event_id", rooms.normalise_room(F.expr(RAW_ROOM.format(s="string"))).alias("room"))


@query(
    "fn_excel_serial",
    "event_id:i parsed:t",
    """SELECT event_id, CASE WHEN regexp_full_match(t, '\\d+(\\.\\d+)?') AND CAST(t AS DOUBLE) > 20000
         THEN make_timestamp(CAST(round((CAST(t AS DOUBLE) - 25569) * 86400000000) AS BIGINT))
         ELSE TRY_CAST(t AS TIMESTAMP) END AS parsed
       FROM (SELECT event_id, CASE user_id % 3 WHEN 0 THEN CAST(45292 + event_id % 1000 AS VARCHAR) || '.25'
         WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'on ' || event_type END AS t FROM events)""",
)
def _(spark, sf):
    group = F.col("user_id") % 3
    text = (
        F.when(group == 0, F.concat((F.lit(45292) + F.col("event_id") % 1000).cast("string"), F.lit(".25")))
        .when(group == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.concat(F.lit("on "), "event_type"))
    )
    return A.events(spark, sf).select("event_id", timefn.excel_or_text_ts(text).alias("parsed"))


@query("fn_acc_magnitude", "event_id:i magnitude:f", "SELECT event_id, sqrt(value*value + (value/2)*(value/2) + 1) AS magnitude FROM events")
def _(spark, sf):
    return A.events(spark, sf).select("event_id", signal.magnitude(F.col("value"), F.col("value") / 2, F.lit(1.0)).alias("magnitude"))


@query(
    "fn_spike_clip",
    "event_id:i replaced:f capped:f spike:b",
    """SELECT event_id, CASE WHEN 1 + value/1000 > 1.2 THEN 1.0 ELSE 1 + value/1000 END AS replaced,
       least(1 + value/1000, 1.2) AS capped, 1 + value/1000 > 1.2 AS spike FROM events""",
)
def _(spark, sf):
    m = F.lit(1) + F.col("value") / 1000
    return A.events(spark, sf).select(
        "event_id", signal.spike_clip(m).alias("replaced"), signal.spike_clip(m, mode="cap").alias("capped"), (m > 1.2).alias("spike")
    )


@query("fn_pressure_height", "event_id:i metres:f", "SELECT event_id, (value % 10 - 5) * -8.3 AS metres FROM events")
def _(spark, sf):
    return A.events(spark, sf).select("event_id", signal.pressure_height(F.col("value") % 10 - 5).alias("metres"))


# offsets without daylight saving keep the oracle free of a time-zone database
@query(
    "fn_local_time",
    "event_id:i local_date:d local_hour:i",
    """SELECT event_id, CAST(l AS DATE) AS local_date, hour(l) AS local_hour FROM (SELECT event_id,
       ts + CASE user_id % 3 WHEN 0 THEN INTERVAL 0 HOUR WHEN 1 THEN INTERVAL (-7) HOUR ELSE INTERVAL 9 HOUR END AS l FROM events)""",
)
def _(spark, sf):
    zone = F.when(F.col("user_id") % 3 == 0, "UTC").when(F.col("user_id") % 3 == 1, "Etc/GMT+7").otherwise("Asia/Tokyo")
    ev = A.events(spark, sf).withColumn("l", timefn.local_ts("ts", zone))
    return ev.select("event_id", F.to_date("l").alias("local_date"), F.hour("l").alias("local_hour"))


@query(
    "fn_night_window",
    "event_id:i night_22_7:b night_18_10:b",
    """SELECT event_id, hour(ts) >= 22 OR hour(ts) < 7 AS night_22_7, hour(ts) >= 18 OR hour(ts) < 10 AS night_18_10 FROM events""",
)
def _(spark, sf):
    return A.events(spark, sf).select(
        "event_id", timefn.is_night("ts").alias("night_22_7"), timefn.is_night("ts", 18, 10).alias("night_18_10")
    )


@query(
    "fn_sleep_night",
    "event_id:i night:d",
    "SELECT event_id, CASE WHEN hour(ts) >= 18 THEN CAST(ts AS DATE) ELSE CAST(ts AS DATE) - 1 END AS night FROM events",
)
def _(spark, sf):
    return A.events(spark, sf).select("event_id", timefn.sleep_night("ts").alias("night"))


@query(
    "fn_noon_period",
    "event_id:i period_start:t period_end:t period_minute:g",
    """SELECT event_id, p AS period_start, p + INTERVAL 1 DAY AS period_end, (epoch_us(ts) - epoch_us(p)) / 60000000.0 AS period_minute
       FROM (SELECT event_id, ts, CAST(date_trunc('day', ts - INTERVAL 12 HOUR) AS TIMESTAMP) + INTERVAL 12 HOUR AS p FROM events)""",
)
def _(spark, sf):
    ev = A.events(spark, sf).withColumn("period_start", timefn.noon_period_start("ts"))
    return ev.select(
        "event_id", "period_start", timefn.shift_ts("period_start", 86_400).alias("period_end"),
        timefn.minutes_between("period_start", "ts").alias("period_minute"),
    )


cte(
    inc="""SELECT *, greatest(coalesce(cnt - prev_cnt, 0), 0) AS increment, coalesce(cnt < prev_cnt, false) AS reset
     FROM (SELECT session_id, ts, event_id, cnt, lag(cnt) OVER o AS prev_cnt, lag(ts) OVER o AS prev_ts
     FROM steps WINDOW o AS (PARTITION BY session_id ORDER BY ts, event_id))""",
    stepw="""SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, sum(increment) AS steps_in_window, count(cnt) AS step_samples
     FROM inc GROUP BY 1, 2""",
)


@query(
    "fn_step_scale",
    "session_id:i w:t width:f",
    with_ctes("""SELECT s.session_id, s.w, CASE WHEN u.up IS NULL OR u.up <= 0 THEN 2.5
        ELSE 1.8 + 7.8 * least(ln(1 + s.steps_in_window) / u.up, 1) END AS width
      FROM stepw s JOIN (SELECT pair_id, quantile_cont(ln(1 + steps_in_window), 0.98) AS up
        FROM stepw JOIN pairs ON session_id = left_session OR session_id = right_session GROUP BY pair_id) u
      ON s.session_id // 2 = u.pair_id"""),
)
def _(spark, sf):
    steps = windows.step_increments(A.step_samples(spark, sf), ["event_id"])
    w = steps.groupBy("session_id", timefn.floor_ts("ts", 3600).alias("w")).agg(F.sum("increment").alias("steps"))
    member = A.pairs(spark).select("pair_id", F.explode(F.array("left_session", "right_session")).alias("session_id"))
    w = w.join(member, "session_id")
    upper = w.groupBy("pair_id").agg(F.percentile(signal.log_steps("steps"), F.lit(0.98)).alias("upper"))
    return w.join(upper, "pair_id").select("session_id", "w", signal.step_line_width("steps", "upper").alias("width"))


cte(
    wins="""SELECT session_id, w, beacon, wins, wins / sum(wins) OVER (PARTITION BY session_id, w) AS share FROM (
       SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, beacon, count(*) AS wins FROM (
         SELECT session_id, ts, beacon, row_number() OVER (PARTITION BY session_id, ts ORDER BY rssi DESC, beacon) AS r
         FROM (SELECT session_id, ts, beacon, avg(rssi) AS rssi FROM rssi GROUP BY 1, 2, 3)) WHERE r = 1 GROUP BY 1, 2, 3)""",
    rw="""SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, beacon, sum(rssi) AS rssi_sum, count(rssi) AS rssi_cnt,
       avg(rssi) AS rssi_mean FROM rssi GROUP BY 1, 2, 3""",
    rtop="""SELECT session_id, w, max(CASE WHEN r = 1 THEN beacon END) AS strongest_beacon,
       max(CASE WHEN r = 1 THEN rssi_mean END) AS strongest_rssi, max(CASE WHEN r = 2 THEN rssi_mean END) AS second_rssi,
       sum(rssi_cnt) AS rssi_sample_count, count(rssi_mean) AS rssi_available_beacons,
       max(CASE WHEN r = 1 THEN rssi_mean END) - max(CASE WHEN r = 2 THEN rssi_mean END) AS gap_db
       FROM (SELECT *, row_number() OVER (PARTITION BY session_id, w ORDER BY rssi_mean DESC NULLS LAST, beacon) AS r FROM rw)
       GROUP BY 1, 2""",
    dom="""SELECT session_id, w, max(share) AS dominance FROM wins GROUP BY 1, 2""",
)


def window_evidence(spark, sf):
    """Hourly strongest beacon with gap, dominance and steps (query input)."""
    from ..operators import topk

    samples = A.rssi_samples(spark, sf)
    top = topk.strongest_beacon(windows.rssi_window_agg(samples, 3600))
    dom = topk.strongest_share(samples, 3600).groupBy("session_id", "w").agg(F.max("dominance").alias("dominance"))
    steps = windows.step_increments(A.step_samples(spark, sf), ["event_id"])
    sw = steps.groupBy("session_id", timefn.floor_ts("ts", 3600).alias("w")).agg(
        F.sum("increment").alias("steps_in_window"), F.count("cnt").alias("step_samples")
    )
    return top.join(dom, ["session_id", "w"]).join(sw, ["session_id", "w"])


@query(
    "fn_rssi_confidence",
    "session_id:i w:t confidence:f cluster_confidence:f",
    with_ctes("""SELECT session_id, w, 0.6 * least(greatest(dominance, 0), 1) + 0.4 * (least(greatest(coalesce(gap_db, 0), 0), 15) / 15) AS confidence,
       0.4 * (least(greatest(coalesce(gap_db, 0), 0), 15) / 15) + 0.6 AS cluster_confidence FROM rtop JOIN dom USING (session_id, w)"""),
)
def _(spark, sf):
    return window_evidence(spark, sf).select(
        "session_id", "w", signal.rssi_confidence("dominance", "gap_db").alias("confidence"),
        signal.cluster_confidence("gap_db", "rssi_observed").alias("cluster_confidence"),
    )


@query(
    "fn_location_confidence",
    "session_id:i w:t score:f label:s",
    with_ctes("""SELECT session_id, w, 0.4 * greatest(0, 1 - least(steps_in_window, 100) / 100) + 0.4 * least(greatest(dominance, 0), 1)
         + 0.2 * least(greatest(g, 0), 10) / 10 AS score,
       CASE WHEN steps_in_window <= 10 AND dominance >= 0.7 AND g >= 3 THEN 'High'
            WHEN steps_in_window <= 100 AND dominance >= 0.5 AND g >= 1 THEN 'Medium' ELSE 'Low' END AS label
       FROM (SELECT session_id, w, steps_in_window, dominance, coalesce(gap_db, 0) AS g FROM rtop JOIN dom USING (session_id, w) JOIN stepw USING (session_id, w))"""),
)
def _(spark, sf):
    e = window_evidence(spark, sf).withColumn("g", F.coalesce("gap_db", F.lit(0.0)))
    return e.select(
        "session_id", "w", signal.location_confidence_score("steps_in_window", "dominance", "g").alias("score"),
        signal.location_confidence_label("steps_in_window", "dominance", "g").alias("label"),
    )


@query(
    "fn_fill_features",
    "session_id:i w:t mean_rssi:f gap_db:f cluster_rssi:f steps:f",
    with_ctes("""SELECT session_id, w, coalesce(strongest_rssi, -110) AS mean_rssi, coalesce(gap_db, 0) AS gap_db,
       coalesce(second_rssi, -100) AS cluster_rssi, coalesce(steps_in_window, 0) AS steps
       FROM rtop FULL JOIN stepw USING (session_id, w)"""),
)
def _(spark, sf):
    e = window_evidence(spark, sf).select("session_id", "w", F.col("strongest_rssi").alias("mean_rssi"), "gap_db",
                                          F.col("second_rssi").alias("cluster_rssi"), F.col("steps_in_window").alias("steps"))
    return filters.fill_features(e, rssi_prefixes=("mean_",), other={"cluster_rssi": -100.0})


# tags whose uuid starts with 4 hex characters are beacons; the raw event type is not one
cte(
    tags="""SELECT session_id, event_id, ts, CASE WHEN user_id % 7 = 0 THEN event_type ELSE md5(event_type) END AS uuid,
      -(40 + value % 50) AS rssi FROM ev""",
    whitelist="""SELECT upper(substr(md5(beacon), 1, 4)) AS beacon, room, floor FROM beacons WHERE beacon <> 'error'""",
)


def tag_rows(spark, sf):
    uuid = F.when(F.col("user_id") % 7 == 0, F.col("event_type")).otherwise(F.md5(F.col("event_type").cast("binary")))
    return A.events(spark, sf).select("session_id", "event_id", "ts", uuid.alias("uuid"), (-(F.lit(40) + F.col("value") % 50)).alias("rssi"))


def whitelist(spark):
    b = A.beacons(spark).filter("beacon <> 'error'")
    return b.select(F.upper(F.substring(F.md5(F.col("beacon").cast("binary")), 1, 4)).alias("beacon"), "room", "floor")


@query(
    "flt_allowed_beacons",
    "event_id:i beacon:s rssi:f",
    with_ctes("""SELECT event_id, upper(substr(uuid, 1, 4)) AS beacon, rssi FROM tags
      WHERE regexp_full_match(upper(substr(uuid, 1, 4)), '[0-9A-F]{4}') AND upper(substr(uuid, 1, 4)) IN (SELECT beacon FROM whitelist)"""),
)
def _(spark, sf):
    return filters.allowed_beacons(tag_rows(spark, sf), whitelist(spark))


cte(
    validity="""SELECT user_id AS session_id, event_type AS beacon, event_type || '@' || CAST(event_id % 3 AS VARCHAR) AS room, event_id AS seq,
      min(ts) OVER (PARTITION BY user_id, event_type, event_id % 3) AS valid_from, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + INTERVAL 3 DAY END AS valid_to
      FROM events""",
)


def validity(spark, sf):
    """Slowly changing beacon rooms: one row per event, open-ended every fifth."""
    ev = A.events(spark, sf)
    first = ev.groupBy("user_id", "event_type", (F.col("event_id") % 3).alias("slot")).agg(F.min("ts").alias("valid_from"))
    rows = ev.withColumn("slot", F.col("event_id") % 3).join(first, ["user_id", "event_type", "slot"])
    return rows.select(
        F.col("user_id").alias("session_id"), F.col("event_type").alias("beacon"),
        F.concat("event_type", F.lit("@"), F.col("slot").cast("string")).alias("room"), F.col("event_id").alias("seq"), "valid_from",
        F.when(F.col("event_id") % 5 != 0, timefn.shift_ts("ts", 3 * 86_400)).alias("valid_to"),
    )


@query(
    "flt_active_beacons",
    "session_id:i beacon:s seq:i",
    with_ctes("""SELECT v.session_id, v.beacon, v.seq FROM validity v JOIN
      (SELECT user_id AS session_id, min(ts) + INTERVAL 15 DAY AS a, max(ts) AS b FROM events GROUP BY 1) s USING (session_id)
      WHERE v.valid_from < s.b AND (v.valid_to IS NULL OR v.valid_to > s.a)"""),
)
def _(spark, sf):
    span = A.events(spark, sf).groupBy(F.col("user_id").alias("session_id")).agg(
        timefn.shift_ts(F.min("ts"), 15 * 86_400).alias("start"), F.max("ts").alias("end")
    )
    return filters.active_beacons(validity(spark, sf), span)


@query(
    "prj_capability",
    "session_id:i has_rssi:b has_acc:b has_steps:b has_pressure:b has_reference:b",
    with_ctes("""SELECT user_id AS session_id, bool_or(event_type IN ('click','view')) AS has_rssi, bool_or(event_type = 'error') AS has_acc,
      bool_or(event_type = 'purchase') AS has_steps, bool_or(event_type = 'signup') AS has_pressure, bool_or(value > 250) AS has_reference
      FROM events GROUP BY 1"""),
)
def _(spark, sf):
    ev = A.events(spark, sf).withColumn("session_id", F.col("user_id"))
    sensors = {
        "rssi": ev.filter(F.col("event_type").isin("click", "view")),
        "acc": ev.filter("event_type = 'error'"),
        "steps": ev.filter("event_type = 'purchase'"),
        "pressure": ev.filter("event_type = 'signup'"),
        "reference": ev.filter("value > 250"),
    }
    return filters.capability(ev.select("session_id").distinct(), sensors)


@query(
    "prj_location_provenance",
    "event_id:i location_confidence:s was_corrected:b",
    with_ctes("""SELECT event_id, CASE ev WHEN 'observed_raw' THEN 'observed' WHEN 'awake_adaptive' THEN 'supported_inference'
       WHEN 'sleep_episode_locked' THEN 'supported_inference' WHEN 'sleep_gap_context_filled' THEN 'supported_inference'
       WHEN 'missing' THEN 'missing' ELSE 'uncertain' END AS location_confidence, coalesce(c, '') <> coalesce(r, '') AS was_corrected
      FROM (SELECT event_id, CASE reference WHEN 'click' THEN 'observed_raw' WHEN 'error' THEN 'awake_adaptive' WHEN 'purchase' THEN 'missing'
        WHEN 'signup' THEN 'sleep_episode_locked' ELSE 'else' END AS ev, prediction AS c, CASE WHEN value > 50 THEN reference END AS r FROM pred)"""),
)
def _(spark, sf):
    evidence = (
        F.when(F.col("reference") == "click", "observed_raw").when(F.col("reference") == "error", "awake_adaptive")
        .when(F.col("reference") == "purchase", "missing").when(F.col("reference") == "signup", "sleep_episode_locked").otherwise("else")
    )
    p = A.predictions(spark, sf).select(
        "event_id", evidence.alias("location_evidence"), F.col("prediction").alias("corrected_beacon"),
        F.when(F.col("value") > 50, F.col("reference")).alias("raw_beacon"),
    )
    return filters.location_provenance(p, raw="raw_beacon")
