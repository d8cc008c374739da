"""Agreement metrics, co-presence and other reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import signal, timefn
from ..operators import copresence as co
from ..operators import intervals as iv
from ..operators import metrics as me
from ..operators import runs, topk
from ..operators import windows as win
from ..registry import query
from .ctes import cte, with_ctes
from .joins import overlapping
from .scalar import window_evidence

HOUR = 3600
METHODS = ["m_prev", "m_value", "m_session"]

cte(
    mp="""SELECT session_id, event_id, ts, value, CASE WHEN value >= 2 THEN reference END AS reference, prediction AS m_prev,
      CASE WHEN value < 20 THEN NULL WHEN value < 60 THEN reference WHEN value < 70 THEN 'Unknown' ELSE prediction END AS m_value,
      CASE session_id WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' ELSE 'signup' END AS m_session FROM pred""",
    mpl="""SELECT session_id, event_id, value, reference, 'm_prev' AS method, m_prev AS prediction FROM mp UNION ALL
      SELECT session_id, event_id, value, reference, 'm_value', m_value FROM mp UNION ALL SELECT session_id, event_id, value, reference, 'm_session', m_session FROM mp""",
    mev="""SELECT * FROM mpl WHERE reference IS NOT NULL AND prediction IS NOT NULL AND prediction <> 'Unknown'""",
)


def method_predictions(spark, sf):
    p = A.predictions(spark, sf)
    s = F.col("session_id")
    return p.select(
        "session_id", "event_id", "ts", "value", F.when(F.col("value") >= 2, F.col("reference")).alias("reference"), F.col("prediction").alias("m_prev"),
        F.when(F.col("value") < 20, F.lit(None)).when(F.col("value") < 60, F.col("reference")).when(F.col("value") < 70, "Unknown").otherwise(F.col("prediction")).alias("m_value"),
        F.when(s == 0, "click").when(s == 1, "view").when(s == 2, "error").otherwise("signup").alias("m_session"),
    )


def long_predictions(spark, sf):
    return me.predictions_long(method_predictions(spark, sf), ["session_id", "event_id", "value", "reference"], METHODS)


def metrics_sql(src: str, keys: str) -> str:
    """Metrics straight from rows of ``src`` (oracle side)."""
    on = " AND ".join(f"t.{k.strip()} = l.{k.strip()}" for k in keys.split(","))
    return f"""SELECT t.*, evaluable_windows / reference_windows AS coverage, l.balanced_accuracy, l.macro_f1 FROM (
      SELECT {keys}, count(*) AS reference_windows, count(*) FILTER (WHERE prediction IS NOT NULL AND prediction <> 'Unknown') AS evaluable_windows,
       avg(CASE WHEN prediction IS NOT NULL AND prediction <> 'Unknown' THEN CAST(reference = prediction AS INT) END) AS conditional_accuracy,
       avg(CAST(reference = coalesce(prediction, 'Unknown') AS INT)) AS end_to_end_accuracy FROM {src} WHERE reference IS NOT NULL GROUP BY {keys}) t
      LEFT JOIN (SELECT {keys}, avg(CASE WHEN r > 0 THEN tp / r END) AS balanced_accuracy, avg(2 * tp / (r + p)) AS macro_f1 FROM (
       SELECT {keys}, label, sum(r) AS r, sum(p) AS p, sum(tp) AS tp FROM (
        SELECT {keys}, reference AS label, 1 AS r, 0 AS p, CAST(reference = prediction AS INT) AS tp FROM {src} WHERE reference IS NOT NULL AND prediction IS NOT NULL AND prediction <> 'Unknown'
        UNION ALL SELECT {keys}, prediction, 0, 1, 0 FROM {src} WHERE reference IS NOT NULL AND prediction IS NOT NULL AND prediction <> 'Unknown') GROUP BY {keys}, label) GROUP BY {keys}) l ON {on}"""


METRIC_OUT = "reference_windows:i evaluable_windows:i coverage:f conditional_accuracy:f balanced_accuracy:f macro_f1:f end_to_end_accuracy:f"


@query("classification_metrics", f"session_id:i method:s {METRIC_OUT}", with_ctes(metrics_sql("mpl", "session_id, method")))
def _(spark, sf):
    return me.classification_metrics(long_predictions(spark, sf), ["session_id", "method"])


@query("confusion_dense", "session_id:i method:s reference:s prediction:s n:i",
       with_ctes("""SELECT a.session_id, a.method, a.label AS reference, b.label AS prediction, coalesce(c.n, 0) AS n FROM labs a JOIN labs b ON a.session_id = b.session_id AND a.method = b.method
         LEFT JOIN (SELECT session_id, method, reference, prediction, count(*) AS n FROM mev GROUP BY ALL) c
         ON c.session_id = a.session_id AND c.method = a.method AND c.reference = a.label AND c.prediction = b.label""",
                 labs="SELECT session_id, method, reference AS label FROM mev UNION SELECT session_id, method, prediction FROM mev"))
def _(spark, sf):
    return me.confusion_dense(long_predictions(spark, sf), ["session_id", "method"])


@query("recall_by_label", "session_id:i method:s reference:s windows:i recall:f most_common_prediction:s",
       with_ctes("""SELECT a.*, b.p AS most_common_prediction FROM (SELECT session_id, method, reference, count(*) AS windows, avg(CAST(coalesce(reference = prediction, false) AS INT)) AS recall
         FROM mpl WHERE reference IS NOT NULL GROUP BY 1, 2, 3) a LEFT JOIN (SELECT session_id, method, reference, arg_min(prediction, (-n, prediction)) AS p FROM (
          SELECT session_id, method, reference, prediction, count(*) AS n FROM mpl WHERE prediction IS NOT NULL GROUP BY ALL) GROUP BY 1, 2, 3) b USING (session_id, method, reference)"""))
def _(spark, sf):
    return me.recall_by_label(long_predictions(spark, sf), ["session_id", "method"])


@query("ppa_npa", "session_id:i method:s label:s positive_windows:i negative_windows:i ppa:f npa:f",
       with_ctes("""SELECT l.session_id, l.method, l.label, count(*) FILTER (WHERE m.reference = l.label) AS positive_windows, count(*) FILTER (WHERE m.reference <> l.label) AS negative_windows,
         avg(CASE WHEN m.reference = l.label THEN CAST(m.prediction = l.label AS INT) END) AS ppa, avg(CASE WHEN m.reference <> l.label THEN CAST(m.prediction <> l.label AS INT) END) AS npa
         FROM (SELECT session_id, method, reference AS label FROM mv UNION SELECT session_id, method, prediction FROM mv) l JOIN mv m USING (session_id, method) GROUP BY 1, 2, 3""",
                 mv="SELECT * FROM mpl WHERE reference IS NOT NULL AND prediction IS NOT NULL"))
def _(spark, sf):
    return me.ppa_npa(long_predictions(spark, sf), ["session_id", "method"])


@query("pairwise_agreement", "session_id:i method_a:s method_b:s windows:i agreement_fraction:f difference_fraction:f",
       with_ctes("""SELECT a.session_id, a.method AS method_a, b.method AS method_b, count(*) FILTER (WHERE a.prediction IS NOT NULL AND b.prediction IS NOT NULL) AS windows,
         avg(CAST(a.prediction = b.prediction AS INT)) AS agreement_fraction, 1 - avg(CAST(a.prediction = b.prediction AS INT)) AS difference_fraction
         FROM mpl a JOIN mpl b USING (session_id, event_id) GROUP BY 1, 2, 3"""))
def _(spark, sf):
    return me.pairwise_agreement(method_predictions(spark, sf), ["session_id"], METHODS)


@query("predictions_long", "session_id:i event_id:i reference:s method:s prediction:s", with_ctes("SELECT session_id, event_id, reference, method, prediction FROM mpl"))
def _(spark, sf):
    return long_predictions(spark, sf)


@query("metrics_by_confidence", f"band:s {METRIC_OUT} windows:i band_coverage:f mean_value:f",
       with_ctes(f"""SELECT m.*, c.windows, c.windows / (SELECT count(*) FROM mb) AS band_coverage, c.mean_value FROM ({metrics_sql('mb', 'band')}) m
         JOIN (SELECT band, count(*) AS windows, avg(value) AS mean_value FROM mb GROUP BY 1) c USING (band)""",
                 mb="SELECT *, CASE WHEN value < 30 THEN 'High' WHEN value < 80 THEN 'Medium' ELSE 'Low' END AS band FROM mpl WHERE method = 'm_prev'"))
def _(spark, sf):
    p = method_predictions(spark, sf).withColumn("prediction", F.col("m_prev"))
    band = F.when(F.col("value") < 30, "High").when(F.col("value") < 80, "Medium").otherwise("Low")
    return me.metrics_by_band(p.withColumn("band", band), "band", ["value"])


@query("metrics_by_threshold", f"method:s step_threshold:f {METRIC_OUT} total_labelled:i threshold_coverage:f",
       with_ctes(f"""SELECT m.*, t.total_labelled, m.reference_windows / t.total_labelled AS threshold_coverage FROM ({metrics_sql('mt', 'method, step_threshold')}) m
         JOIN (SELECT method, count(reference) AS total_labelled FROM mpl GROUP BY 1) t USING (method)""",
                 mt="SELECT * FROM (SELECT *, unnest([0, 5, 10, 20, 30, 50, 100]) AS step_threshold FROM mpl) WHERE floor(value) <= step_threshold"))
def _(spark, sf):
    p = long_predictions(spark, sf).withColumn("steps", F.floor("value").cast("double"))
    return me.metrics_by_threshold(p, "steps", (0, 5, 10, 20, 30, 50, 100), ["method"])


@query("beacon_room_crosstab", "session_id:i beacon:s reference:s n:i mapped_room:s agreement:f",
       with_ctes("""SELECT c.session_id, c.beacon, c.reference, c.n, m.mapped_room, sum(CASE WHEN c.reference = m.mapped_room THEN c.n ELSE 0 END) OVER w / sum(c.n) OVER w AS agreement
         FROM x c JOIN (SELECT session_id, beacon, arg_min(reference, (-n, reference)) AS mapped_room FROM x GROUP BY 1, 2) m USING (session_id, beacon) WINDOW w AS (PARTITION BY c.session_id)""",
                 x="""SELECT r.session_id, r.strongest_beacon AS beacon, d.label AS reference, count(*) AS n FROM rtop r JOIN domlab d USING (session_id, w) WHERE overlap_fraction >= 0.5 GROUP BY 1, 2, 3"""))
def _(spark, sf):
    top = topk.strongest_beacon(win.rssi_window_agg(A.rssi_samples(spark, sf), HOUR))
    lab = iv.join_overlap_majority(top, A.intervals(spark, sf), HOUR)
    return me.beacon_room_crosstab(lab.withColumnRenamed("label", "reference"), ["session_id"], "strongest_beacon")


# -- hourly timeline with states -----------------------------------------------
cte(
    htl="""SELECT g.session_id, g.w, CASE WHEN r.strongest_beacon <> 'error' THEN b.room END AS raw_room, CASE WHEN a.av < 20 THEN 'Bedroom' WHEN r.strongest_beacon <> 'error' THEN b.room END AS corrected_room,
       CASE WHEN r.strongest_beacon IS NULL OR r.strongest_beacon = 'error' THEN 'unknown' WHEN a.av >= 90 THEN 'probable_away' WHEN a.av < 30 THEN 'indoor_inferred_sleep' ELSE 'indoor_observed' END AS occupancy_state,
       CASE WHEN a.av < 25 THEN 'main_sleep' WHEN a.av >= 90 THEN 'away' ELSE 'awake' END AS behaviour_state
      FROM hgrid g LEFT JOIN rtop r USING (session_id, w) LEFT JOIN beacons b ON b.beacon = r.strongest_beacon
      LEFT JOIN (SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, round(avg(value), 6) AS av FROM ev GROUP BY 1, 2) a USING (session_id, w)""",
    diary="""SELECT session_id, event_id AS seq, ts AS "start", ts + INTERVAL 2 HOUR AS "end", room AS label FROM ev JOIN beacons ON beacon = event_type""",
)


def hourly_states(spark, sf):
    cells = win.rssi_window_agg(A.rssi_samples(spark, sf), HOUR)
    top = topk.strongest_beacon(cells, A.beacons(spark))
    av = A.events(spark, sf).groupBy("session_id", timefn.floor_ts("ts", HOUR).alias("w")).agg(F.round(F.avg("value"), 6).alias("av"))
    out = win.window_grid(cells, HOUR).join(top, ["session_id", "w"], "left").join(av, ["session_id", "w"], "left")
    heard = F.col("strongest_beacon") != "error"
    raw = F.when(heard, F.col("room"))
    return out.select(
        "session_id", "w", raw.alias("raw_room"), F.when(F.col("av") < 20, "Bedroom").otherwise(raw).alias("corrected_room"),
        F.when(F.col("strongest_beacon").isNull() | ~heard, "unknown").when(F.col("av") >= 90, "probable_away").when(F.col("av") < 30, "indoor_inferred_sleep")
        .otherwise("indoor_observed").alias("occupancy_state"),
        F.when(F.col("av") < 25, "main_sleep").when(F.col("av") >= 90, "away").otherwise("awake").alias("behaviour_state"),
    )


def diary(spark, sf):
    b = F.broadcast(A.beacons(spark).select(F.col("beacon").alias("label"), "room"))
    return overlapping(spark, sf).join(b, "label").drop("label").withColumnRenamed("room", "label")


cte(
    evr="""SELECT h.session_id, 'raw_strongest_rssi' AS method, raw_room AS prediction, (SELECT arg_max(label, seq) FROM diary d WHERE d.session_id = h.session_id AND h.w >= d."start" AND h.w < d."end") AS reference FROM htl h
      UNION ALL SELECT h.session_id, 'movement_supported_corrected', CASE WHEN occupancy_state = 'probable_away' THEN 'Out' ELSE corrected_room END,
       (SELECT arg_max(label, seq) FROM diary d WHERE d.session_id = h.session_id AND h.w >= d."start" AND h.w < d."end") FROM htl h""",
)


@query("evaluate_reference", f"session_id:i method:s {METRIC_OUT}", with_ctes(metrics_sql("evr", "session_id, method")))
def _(spark, sf):
    return me.evaluate_reference(hourly_states(spark, sf), diary(spark, sf), HOUR)[0]


@query("evaluate_reference_confusion", "session_id:i method:s reference:s prediction:s n:i",
       with_ctes("""SELECT a.session_id, a.method, a.label AS reference, b.label AS prediction, coalesce(c.n, 0) AS n FROM l a JOIN l b ON a.session_id = b.session_id AND a.method = b.method
         LEFT JOIN (SELECT session_id, method, reference, prediction, count(*) AS n FROM e GROUP BY ALL) c ON c.session_id = a.session_id AND c.method = a.method AND c.reference = a.label AND c.prediction = b.label""",
                 e="SELECT * FROM evr WHERE reference IS NOT NULL AND prediction IS NOT NULL AND prediction <> 'Unknown'",
                 l="SELECT session_id, method, reference AS label FROM e UNION SELECT session_id, method, prediction FROM e"))
def _(spark, sf):
    return me.evaluate_reference(hourly_states(spark, sf), diary(spark, sf), HOUR)[1]


cte(
    cpp="""SELECT p.pair_id, l.w, CASE WHEN l.occupancy_state = 'unknown' OR r.occupancy_state = 'unknown' THEN 'unknown' WHEN l.occupancy_state = 'probable_away' OR r.occupancy_state = 'probable_away' THEN 'away'
        WHEN l.behaviour_state = 'main_sleep' OR r.behaviour_state = 'main_sleep' THEN 'sleep' ELSE 'awake' END AS stratum, coalesce(l.raw_room = r.raw_room, false) AS a,
       coalesce(l.corrected_room = r.corrected_room, false) AND l.occupancy_state LIKE 'indoor%' AND r.occupancy_state LIKE 'indoor%' AS c
      FROM pairs p JOIN htl l ON l.session_id = left_session JOIN htl r ON r.session_id = right_session AND r.w = l.w""",
)


@query("copresence_pair", "pair_id:i stratum:s overlap_windows:i raw_copresent_windows:i corrected_copresent_windows:i added_copresent_windows:i removed_copresent_windows:i raw_copresent_hours:f corrected_copresent_hours:f",
       with_ctes("""SELECT pair_id, coalesce(stratum, 'all') AS stratum, count(*) AS overlap_windows, sum(CAST(a AS INT)) AS raw_copresent_windows, sum(CAST(c AS INT)) AS corrected_copresent_windows,
         sum(CAST(NOT a AND c AS INT)) AS added_copresent_windows, sum(CAST(a AND NOT c AS INT)) AS removed_copresent_windows, sum(CAST(a AS INT)) * 1.0 AS raw_copresent_hours,
         sum(CAST(c AS INT)) * 1.0 AS corrected_copresent_hours FROM cpp GROUP BY GROUPING SETS ((pair_id, stratum), (pair_id))"""))
def _(spark, sf):
    return co.copresence_pair(hourly_states(spark, sf), A.pairs(spark), HOUR)[1]


# -- evidence timeline ---------------------------------------------------------
cte(
    evd="""SELECT session_id, w, strongest_beacon AS beacon, CASE WHEN strongest_beacon = 'error' THEN 'Unmapped' ELSE b.room END AS room, strongest_beacon <> 'error' AS in_home, dominance, gap_db,
       0.6 * dominance + 0.4 * (least(greatest(coalesce(gap_db, 0), 0), 15) / 15) AS confidence, steps_in_window AS steps, rssi_sample_count AS samples, m.motion
      FROM rtop r JOIN dom USING (session_id, w) JOIN stepw USING (session_id, w) JOIN beacons b ON b.beacon = r.strongest_beacon
      JOIN (SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, stddev_pop(value) AS motion FROM ev GROUP BY 1, 2) m USING (session_id, w)""",
    cop="""SELECT *, CASE WHEN lh AND rh AND lr = rr THEN 'both_in_home_same_location' WHEN lh AND rh THEN 'both_in_home_different_location'
        WHEN lh THEN 'subject_in_home_study_partner_away_or_unmapped' WHEN rh THEN 'study_partner_in_home_subject_away_or_unmapped' ELSE 'both_away_or_unmapped' END AS state FROM (
      SELECT g.pair_id, g.w, l.room AS lr, r.room AS rr, coalesce(l.in_home, false) AS lh, coalesce(r.in_home, false) AS rh, least(l.confidence, r.confidence) AS mc, l.confidence IS NULL OR r.confidence IS NULL AS nc
      FROM (SELECT pair_id, left_session, right_session, unnest(generate_series(greatest(a.x, b.x), least(a.y, b.y), INTERVAL 1 HOUR)) AS w FROM pairs
        JOIN (SELECT session_id, min(w) AS x, max(w) AS y FROM evd GROUP BY 1) a ON a.session_id = left_session
        JOIN (SELECT session_id, min(w) AS x, max(w) AS y FROM evd GROUP BY 1) b ON b.session_id = right_session) g
      LEFT JOIN evd l ON l.session_id = left_session AND l.w = g.w LEFT JOIN evd r ON r.session_id = right_session AND r.w = g.w)""",
    states="SELECT unnest(['both_in_home_same_location', 'both_in_home_different_location', 'subject_in_home_study_partner_away_or_unmapped', 'study_partner_in_home_subject_away_or_unmapped', 'both_away_or_unmapped']) AS state",
)


def evidence(spark, sf):
    e = window_evidence(spark, sf).join(F.broadcast(A.beacons(spark).select(F.col("beacon").alias("strongest_beacon"), F.col("room").alias("_r"))), "strongest_beacon")
    motion = A.events(spark, sf).groupBy("session_id", timefn.floor_ts("ts", HOUR).alias("w")).agg(F.stddev_pop("value").alias("motion"))
    heard = F.col("strongest_beacon") != "error"
    return e.join(motion, ["session_id", "w"]).select(
        "session_id", "w", F.col("strongest_beacon").alias("beacon"), F.when(heard, F.col("_r")).otherwise("Unmapped").alias("room"), heard.alias("in_home"), "dominance", "gap_db",
        signal.rssi_confidence("dominance", "gap_db").alias("confidence"), F.col("steps_in_window").alias("steps"), F.col("rssi_sample_count").alias("samples"), "motion",
    )


def pair_states(spark, sf):
    return co.copresence_state(evidence(spark, sf), A.pairs(spark), HOUR)


@query("copresence_state", "pair_id:i w:t left_room:s right_room:s left_in_home:b right_in_home:b state:s minimum_confidence:f",
       with_ctes("SELECT pair_id, w, lr AS left_room, rr AS right_room, lh AS left_in_home, rh AS right_in_home, state, mc AS minimum_confidence FROM cop"))
def _(spark, sf):
    return pair_states(spark, sf)


@query("copresence_summary", "pair_id:i state:s windows:i hours:f share:f total_windows:i total_hours:f",
       with_ctes("""SELECT t.pair_id, s.state, count(c.state) AS windows, count(c.state) * 1.0 AS hours, count(c.state) / any_value(t.n) AS share, any_value(t.n) AS total_windows, any_value(t.n) * 1.0 AS total_hours
         FROM (SELECT pair_id, count(*) AS n FROM cop GROUP BY 1) t JOIN states s ON true LEFT JOIN cop c ON c.pair_id = t.pair_id AND c.state = s.state GROUP BY 1, 2"""))
def _(spark, sf):
    return co.copresence_summary(pair_states(spark, sf), HOUR)


_SUMS = ", ".join(f"sum(CAST(state = '{s}' AS INT)) * 1.0 AS {s}" for s in co.STATES)
_AVGS = ", ".join(f"avg(CAST(state = '{s}' AS INT)) AS {s}" for s in co.STATES)
_OUT = " ".join(f"{s}:f" for s in co.STATES)


@query("copresence_by_day_hour", f"pair_id:i day:d {_OUT}", with_ctes(f"SELECT pair_id, CAST(w AS DATE) AS day, {_SUMS} FROM cop GROUP BY 1, 2"))
def _(spark, sf):
    return co.copresence_by_day(pair_states(spark, sf), HOUR)


@query("copresence_by_hour", f"pair_id:i hour:i {_OUT}", with_ctes(f"SELECT pair_id, hour(w) AS hour, {_AVGS} FROM cop GROUP BY 1, 2"))
def _(spark, sf):
    return co.copresence_by_hour(pair_states(spark, sf))


@query("same_room_by_location", "pair_id:i room:s windows:i hours:f share:f",
       with_ctes("""SELECT pair_id, lr AS room, count(*) AS windows, count(*) * 1.0 AS hours, count(*) / sum(count(*)) OVER (PARTITION BY pair_id) AS share FROM cop
         WHERE state = 'both_in_home_same_location' GROUP BY 1, 2"""))
def _(spark, sf):
    return co.same_room_by_location(pair_states(spark, sf), HOUR)


# -- fine label grid -----------------------------------------------------------
cte(
    diary2="""SELECT session_id, event_id AS seq, "start", "end", CASE WHEN label = 'view' THEN 'Out' ELSE label END AS label FROM ivl""",
    diary2s="""SELECT session_id, "start", arg_max(label, seq) AS label FROM (SELECT session_id, seq, "start", label FROM diary2 UNION ALL SELECT session_id, 1e12, max("end") + INTERVAL 1 MICROSECOND, 'Unknown' FROM diary2 GROUP BY 1) GROUP BY 1, 2""",
    fine="""SELECT p.pair_id, t, coalesce(l.label, 'Unknown') AS ll, coalesce(r.label, 'Unknown') AS rl FROM (
        SELECT pair_id, left_session, right_session, unnest(generate_series(time_bucket(INTERVAL 10 SECOND, greatest(a.x, b.x)), time_bucket(INTERVAL 10 SECOND, least(a.y, b.y) + INTERVAL 9999999 MICROSECOND), INTERVAL 10 SECOND)) AS t
        FROM pairs JOIN (SELECT session_id, min("start") AS x, max("end") AS y FROM diary2 GROUP BY 1) a ON a.session_id = left_session
        JOIN (SELECT session_id, min("start") AS x, max("end") AS y FROM diary2 GROUP BY 1) b ON b.session_id = right_session) p
      ASOF LEFT JOIN diary2s l ON l.session_id = p.left_session AND p.t >= l."start" ASOF LEFT JOIN diary2s r ON r.session_id = p.right_session AND p.t >= r."start\"""",
)


def diary_labels(spark, sf):
    label = F.when(F.col("label") == "view", "Out").otherwise(F.col("label"))
    return A.intervals(spark, sf).select("session_id", F.col("event_id").alias("seq"), "start", "end", label.alias("label"))


_H = ", ".join(f"avg(CASE WHEN hour(t) = {h} THEN CAST(ll = rl AND ll NOT IN ('Out', 'Unknown') AS INT) END) AS h{h:02d}" for h in range(24))
_HO = " ".join(f"h{h:02d}:f" for h in range(24))


@query("copresence_heatmap", f"pair_id:i day:d {_HO}", with_ctes(f"SELECT pair_id, CAST(t AS DATE) AS day, {_H} FROM fine GROUP BY 1, 2"))
def _(spark, sf):
    return co.copresence_heatmap(diary_labels(spark, sf), A.pairs(spark))


@query("copresence_daily_ratio", "pair_id:i day:d hours:i ratio:f",
       with_ctes("""SELECT pair_id, CAST(t AS DATE) AS day, count(DISTINCT hour(t)) AS hours, avg(CAST(ll = rl AND ll <> 'Out' AS INT)) AS ratio FROM fine
         WHERE ll <> 'Unknown' AND rl <> 'Unknown' GROUP BY 1, 2 HAVING count(DISTINCT hour(t)) >= 20"""))
def _(spark, sf):
    return co.copresence_daily_ratio(diary_labels(spark, sf), A.pairs(spark))


@query("hourly_room", "session_id:i w:t label:s",
       with_ctes("""SELECT session_id, w, arg_min(label, (-n, label)) AS label FROM (SELECT session_id, time_bucket(INTERVAL 1 HOUR, t) AS w, coalesce(label, 'Unknown') AS label, count(*) AS n FROM (
          SELECT g.session_id, g.t, d.label FROM (SELECT session_id, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, min("start") + INTERVAL 9999999 MICROSECOND), time_bucket(INTERVAL 1 HOUR, max("end")) + INTERVAL 3590 SECOND, INTERVAL 10 SECOND)) AS t FROM diary2 GROUP BY 1) g
          ASOF LEFT JOIN diary2s d ON d.session_id = g.session_id AND g.t >= d."start") GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def _(spark, sf):
    return co.hourly_room(diary_labels(spark, sf))


@query("left_right_compare", "pair_id:i common_windows:i common_start:t common_end:t same_beacon_fraction:f same_room_fraction:f step_correlation:f motion_correlation:f confidence_correlation:f left_high_right_low:i right_high_left_low:i",
       with_ctes("""SELECT pair_id, count(*) AS common_windows, min(l.w) AS common_start, max(l.w) AS common_end, avg(CAST(l.beacon = r.beacon AS INT)) AS same_beacon_fraction, avg(CAST(l.room = r.room AS INT)) AS same_room_fraction,
         corr(l.steps, r.steps) AS step_correlation, corr(l.motion, r.motion) AS motion_correlation, corr(l.confidence, r.confidence) AS confidence_correlation,
         count(*) FILTER (WHERE l.confidence >= 0.7 AND r.confidence < 0.4) AS left_high_right_low, count(*) FILTER (WHERE r.confidence >= 0.7 AND l.confidence < 0.4) AS right_high_left_low
         FROM pairs JOIN evd l ON l.session_id = left_session JOIN evd r ON r.session_id = right_session AND r.w = l.w GROUP BY 1"""))
def _(spark, sf):
    both = iv.join_pair_inner(evidence(spark, sf), A.pairs(spark), ["beacon", "room", "steps", "motion", "confidence"])
    return co.left_right_compare(both)


@query("role_stability", "session_id:i windows:i in_home_fraction:f mean_confidence:f median_confidence:f mean_dominance:f mean_gap:f transitions:i unmapped_fraction:f transitions_per_day:f",
       with_ctes("""SELECT a.*, b.transitions, 1 - in_home_fraction AS unmapped_fraction, b.transitions / greatest(a.windows / 24, 1) AS transitions_per_day FROM (SELECT session_id, count(*) AS windows,
          avg(CAST(in_home AS INT)) AS in_home_fraction, avg(confidence) AS mean_confidence, quantile_cont(confidence, 0.5) AS median_confidence, avg(dominance) AS mean_dominance, avg(gap_db) AS mean_gap FROM evd GROUP BY 1) a
         JOIN (SELECT session_id, sum(CAST(room <> p AS INT)) AS transitions FROM (SELECT *, lag(room) OVER (PARTITION BY session_id ORDER BY w) AS p FROM evd) GROUP BY 1) b USING (session_id)"""))
def _(spark, sf):
    return co.role_stability(evidence(spark, sf), HOUR)


def method_rooms(spark, sf):
    """Three room estimates per hour: strongest, most samples, diary overlap."""
    cells = win.rssi_window_agg(A.rssi_samples(spark, sf), HOUR)
    rooms = F.broadcast(A.beacons(spark).select("beacon", "room"))
    strongest = topk.strongest_beacon(cells).select("session_id", "w", F.col("strongest_beacon").alias("beacon")).join(rooms, "beacon").select("session_id", "w", F.col("room").alias("v"))
    mode = topk.mode_label(cells, ["session_id", "w"], "beacon", "rssi_cnt").join(rooms, "beacon").select("session_id", "w", F.col("room").alias("v"))
    lab = iv.dominant_label(A.intervals(spark, sf), HOUR).filter("overlap_fraction >= 0.5").withColumnRenamed("label", "beacon").join(rooms, "beacon").select("session_id", "w", F.col("room").alias("v"))
    return win.window_grid(cells, HOUR), {"4a": strongest, "4b": mode, "4c": lab}


cte(
    m3="""SELECT g.session_id, g.w, b1.room AS a, b2.room AS b, b3.room AS c FROM hgrid g LEFT JOIN rtop r USING (session_id, w) LEFT JOIN beacons b1 ON b1.beacon = r.strongest_beacon
      LEFT JOIN (SELECT session_id, w, arg_min(beacon, (-rssi_cnt, beacon)) AS m FROM rw GROUP BY 1, 2) m USING (session_id, w) LEFT JOIN beacons b2 ON b2.beacon = m.m
      LEFT JOIN (SELECT * FROM domlab WHERE overlap_fraction >= 0.5) d USING (session_id, w) LEFT JOIN beacons b3 ON b3.beacon = d.label""",
)


@query("method_state_union", "pair_id:i method:s " + _OUT,
       with_ctes("SELECT pair_id, method, " + ", ".join(f"sum(CAST(state = '{s}' AS INT)) * 1.0 AS {s}" for s in co.STATES) + """ FROM (
         SELECT pair_id, method, CASE WHEN lv IS NOT NULL AND rv IS NOT NULL AND lv = rv THEN 'both_in_home_same_location' WHEN lv IS NOT NULL AND rv IS NOT NULL THEN 'both_in_home_different_location'
           WHEN lv IS NOT NULL THEN 'subject_in_home_study_partner_away_or_unmapped' WHEN rv IS NOT NULL THEN 'study_partner_in_home_subject_away_or_unmapped' ELSE 'both_away_or_unmapped' END AS state FROM (
          SELECT pair_id, g.method, g.w, l.v AS lv, r.v AS rv FROM (SELECT pair_id, left_session, right_session, method, unnest(generate_series(greatest(a.x, b.x), least(a.y, b.y), INTERVAL 1 HOUR)) AS w
            FROM pairs JOIN sp a ON a.session_id = left_session JOIN (SELECT session_id AS bs, method AS bm, x, y FROM sp) b ON b.bs = right_session AND b.bm = a.method) g
          LEFT JOIN lm l ON l.session_id = left_session AND l.w = g.w AND l.method = g.method LEFT JOIN lm r ON r.session_id = right_session AND r.w = g.w AND r.method = g.method)) GROUP BY 1, 2""",
                 lm="SELECT session_id, w, '4a' AS method, a AS v FROM m3 WHERE a IS NOT NULL UNION ALL SELECT session_id, w, '4b', b FROM m3 WHERE b IS NOT NULL UNION ALL SELECT session_id, w, '4c', c FROM m3 WHERE c IS NOT NULL",
                 sp="SELECT session_id, method, min(w) AS x, max(w) AS y FROM lm GROUP BY 1, 2"))
def _(spark, sf):
    _, methods = method_rooms(spark, sf)
    tables = {}
    for name, t in methods.items():
        e = t.select("session_id", "w", F.col("v").alias("room"), F.lit(True).alias("in_home"), F.lit(1.0).alias("confidence"))
        tables[name] = co.copresence_summary(co.copresence_state(e, A.pairs(spark), HOUR), HOUR)
    return co.method_state_hours(co.stack_methods(tables))


@query("method_disagreement", "session_id:i w:t disagreement:s",
       with_ctes("""SELECT session_id, w, CASE WHEN x = y AND x = z THEN 'all agree' WHEN x <> y AND x <> z AND y <> z THEN 'all differ' WHEN x <> y THEN '4a vs 4b differ' WHEN x <> z THEN '4a vs 4c differ'
         ELSE '4b vs 4c differ' END AS disagreement FROM (SELECT session_id, w, coalesce(a, 'Unmapped') AS x, coalesce(b, 'Unmapped') AS y, coalesce(c, 'Unmapped') AS z FROM m3)"""))
def _(spark, sf):
    grid, methods = method_rooms(spark, sf)
    return co.method_disagreement(iv.join_multi_method(grid, methods, "v"), "4a", "4b", "4c")


@query("method_disagreement_summary", "session_id:i method_pair:s agree_hours:f differ_hours:f agree_fraction:f differ_fraction:f total_hours:f",
       with_ctes("""SELECT session_id, method_pair, sum(e) * 1.0 AS agree_hours, (count(*) - sum(e)) * 1.0 AS differ_hours, avg(e) AS agree_fraction, 1 - avg(e) AS differ_fraction, count(*) * 1.0 AS total_hours FROM (
          SELECT session_id, '4a vs 4b' AS method_pair, CAST(x = y AS INT) AS e FROM u UNION ALL SELECT session_id, '4a vs 4c', CAST(x = z AS INT) FROM u UNION ALL SELECT session_id, '4b vs 4c', CAST(y = z AS INT) FROM u) GROUP BY 1, 2""",
                 u="SELECT session_id, w, coalesce(a, 'Unmapped') AS x, coalesce(b, 'Unmapped') AS y, coalesce(c, 'Unmapped') AS z FROM m3"))
def _(spark, sf):
    grid, methods = method_rooms(spark, sf)
    return co.disagreement_summary(iv.join_multi_method(grid, methods, "v"), ["4a", "4b", "4c"], HOUR)


@query("resample_mode_diag", "session_id:i w:t fine_room:s fine_samples:i room:s",
       with_ctes("""SELECT f.session_id, f.w, f.fine_room, f.fine_samples, d.label AS room FROM (SELECT session_id, w, arg_min(room, (-n, room)) AS fine_room, sum(s) AS fine_samples FROM (
           SELECT session_id, time_bucket(INTERVAL 4 HOUR, w) AS w, room, count(*) AS n, sum(samples) AS s FROM evd GROUP BY 1, 2, 3) GROUP BY 1, 2) f
         JOIN (SELECT session_id, w, arg_min(label, (-n, label)) AS label FROM (SELECT session_id, time_bucket(INTERVAL 4 HOUR, ts) AS w, event_type AS label, count(*) AS n FROM ev GROUP BY 1, 2, 3) GROUP BY 1, 2) d USING (session_id, w)
         WHERE f.fine_room = 'Unmapped' AND d.label = 'signup'"""))
def _(spark, sf):
    coarse = topk.mode_label(A.events(spark, sf).select("session_id", timefn.floor_ts("ts", 4 * HOUR).alias("w"), F.col("event_type").alias("room")), ["session_id", "w"], "room")
    return co.resample_mode_diag(evidence(spark, sf).select("session_id", "w", "room", "samples"), coarse.select("session_id", "w", "room"), 4 * HOUR, "signup")


@query("dataset_manifest", "session_id:i reference_rows:i first_label:t last_label:t rssi_rows:i beacons:i step_rows:i",
       with_ctes("""SELECT * FROM (SELECT session_id, count(*) AS reference_rows, min("start") AS first_label, max("end") AS last_label FROM ivl GROUP BY 1)
         JOIN (SELECT session_id, count(*) AS rssi_rows, count(DISTINCT beacon) AS beacons FROM rssi GROUP BY 1) USING (session_id) JOIN (SELECT session_id, count(*) AS step_rows FROM steps GROUP BY 1) USING (session_id)"""))
def _(spark, sf):
    return me.dataset_manifest(A.intervals(spark, sf), A.rssi_samples(spark, sf), A.step_samples(spark, sf))


@query("transition_summary", "session_id:i observed_windows:i observed_hours:f awake_windows:i awake_hours:f transitions:i supported:i unsupported:i floor_switches:i supported_fraction:f per_observed_hour:f per_awake_hour:f supported_per_awake_hour:f unsupported_per_awake_hour:f",
       with_ctes("""SELECT *, observed_windows * 0.25 AS observed_hours, awake_windows * 0.25 AS awake_hours, CASE WHEN transitions > 0 THEN supported / transitions ELSE 0 END AS supported_fraction,
         transitions / (observed_windows * 0.25) AS per_observed_hour, CASE WHEN awake_windows > 0 THEN transitions / (awake_windows * 0.25) ELSE 0 END AS per_awake_hour,
         CASE WHEN awake_windows > 0 THEN supported / (awake_windows * 0.25) ELSE 0 END AS supported_per_awake_hour, CASE WHEN awake_windows > 0 THEN unsupported / (awake_windows * 0.25) ELSE 0 END AS unsupported_per_awake_hour
         FROM (SELECT session_id, count(*) AS observed_windows, sum(CAST(motion AS INT)) AS awake_windows, sum(CAST(coalesce(room_transition, false) AS INT)) AS transitions,
          sum(CAST(coalesce(room_transition AND near, false) AS INT)) AS supported, sum(CAST(coalesce(room_transition AND NOT near, false) AS INT)) AS unsupported, sum(CAST(coalesce(floor_transition, false) AS INT)) AS floor_switches FROM rtf GROUP BY 1)"""))
def _(spark, sf):
    from .ordering import Q, observed_timeline

    return runs.transition_summary(runs.room_transition_features(observed_timeline(spark, sf), Q), Q)


@query("transition_summary_daily", "session_id:i day:d observed_windows:i transitions:i supported:i unsupported:i floor_switches:i per_awake_hour:f supported_per_awake_hour:f",
       with_ctes("""SELECT *, CASE WHEN awake > 0 THEN transitions / (awake * 0.25) ELSE 0 END AS per_awake_hour, CASE WHEN awake > 0 THEN supported / (awake * 0.25) ELSE 0 END AS supported_per_awake_hour
         FROM (SELECT session_id, CAST(w AS DATE) AS day, count(*) AS observed_windows, sum(CAST(motion AS INT)) AS awake, sum(CAST(coalesce(room_transition, false) AS INT)) AS transitions,
          sum(CAST(coalesce(room_transition AND near, false) AS INT)) AS supported, sum(CAST(coalesce(room_transition AND NOT near, false) AS INT)) AS unsupported, sum(CAST(coalesce(floor_transition, false) AS INT)) AS floor_switches FROM rtf GROUP BY 1, 2)"""))
def _(spark, sf):
    from .ordering import Q, observed_timeline

    t = runs.room_transition_features(observed_timeline(spark, sf), Q).withColumn("day", F.to_date("w"))
    return runs.transition_summary(t, Q, ["session_id", "day"])


@query("correction_metrics", "session_id:i metric:s room:s value:f",
       with_ctes("""SELECT session_id, metric, '' AS room, value FROM (UNPIVOT (SELECT session_id, CAST(count(*) AS DOUBLE) AS total_windows, CAST(count(*) FILTER (WHERE raw_room IS NULL) AS DOUBLE) AS raw_missing_windows,
           CAST(count(*) FILTER (WHERE corrected_room IS NULL) AS DOUBLE) AS corrected_missing_windows, CAST(count(*) FILTER (WHERE raw_room IS NULL AND corrected_room IS NOT NULL) AS DOUBLE) AS filled_windows,
           avg(CAST(raw_room = 'Bedroom' AS INT)) AS raw_bedroom_fraction, avg(CAST(corrected_room = 'Bedroom' AS INT)) AS corrected_bedroom_fraction FROM htl GROUP BY 1)
          ON COLUMNS(* EXCLUDE session_id) INTO NAME metric VALUE value)
         UNION ALL SELECT session_id, 'raw_hours', raw_room, count(*) * 1.0 FROM htl WHERE raw_room IS NOT NULL GROUP BY 1, 3
         UNION ALL SELECT session_id, 'corrected_hours', corrected_room, count(*) * 1.0 FROM htl WHERE corrected_room IS NOT NULL GROUP BY 1, 3"""))
def _(spark, sf):
    return me.correction_metrics(hourly_states(spark, sf), HOUR)
