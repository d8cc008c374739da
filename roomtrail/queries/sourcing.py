"""Sources and sinks: events are written in each raw layout below the shared
folder and read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..env import scratch_path
from ..functions import timefn
from ..operators import windows as win
from ..registry import query
from ..sources import annotations as ann
from ..sources import readers as rd
from ..sources import sinks
from .ctes import cte, with_ctes
from .inferring import locked
from .scalar import NORMALISE_SQL, RAW_ROOM, whitelist

HOUR = 3600
MS = "make_timestamp(epoch_us(ts) // 1000 * 1000)"

cte(
    tagb=f"""SELECT session_id, {MS} AS ts, upper(substr(CASE WHEN user_id % 7 = 0 THEN event_type ELSE md5(event_type) END, 1, 4)) AS beacon, -(40 + value % 50) AS rssi, 1000 + value % 10 AS hpa, user_id FROM ev""",
    tagc="""SELECT * FROM tagb WHERE regexp_full_match(beacon, '[0-9A-F]{4}') AND user_id % 11 <> 0""",
)


def _text(c):
    return c.cast("string")


def raw_events(spark, sf):
    ev = A.events(spark, sf)
    ms = F.floor(F.unix_micros("ts") / 1000).cast("bigint")
    uuid = F.when(F.col("user_id") % 7 == 0, F.col("event_type")).otherwise(F.md5(F.col("event_type").cast("binary")))
    return ev.select("session_id", "event_id", "user_id", "event_type", "value", "ts", ms.alias("ms"), uuid.alias("uuid"), (-(F.lit(40) + F.col("value") % 50)).alias("rssi"), (F.lit(1000) + F.col("value") % 10).alias("hpa"))


def combined_file(spark, sf):
    """Headed CSV; every 11th user's readings carry an unreadable level."""
    path = scratch_path(spark, "tags")
    level = F.when(F.col("user_id") % 11 == 0, "n/a").otherwise(_text(F.col("rssi")))
    rows = raw_events(spark, sf).select("session_id", _text(F.col("ms")).alias("timestamp"), "uuid", level.alias("rssi"), _text(F.col("hpa")).alias("pressure_hpa"))
    rows.write.partitionBy("session_id").option("header", True).csv(path)
    return rd.read_tags_combined(spark, path, ("timestamp", "uuid", "rssi", "pressure_hpa"), pressure="pressure_hpa")


@query("src_tags_combined", "session_id:i ts:t beacon:s rssi:f hpa:f", with_ctes("SELECT * FROM tagc"))
def _(spark, sf):
    return combined_file(spark, sf)


def separate_files(spark, sf):
    """One folder of headless CSV per beacon, named like the per-beacon files."""
    root = scratch_path(spark, "separate")
    rows = raw_events(spark, sf).select("session_id", _text(F.col("ms")).alias("a"), F.lit("").alias("b"), _text(F.col("rssi")).alias("c"), "event_type")
    for name, _, _ in A.BEACON_ROWS:
        rows.filter(F.col("event_type") == name).drop("event_type").write.partitionBy("session_id").csv(f"{root}/SAMPLES_TAGS_RSSI_{name}.csv")
    return root


@query("src_tags_separate", "session_id:i ts:t beacon:s rssi:f",
       with_ctes(f"SELECT session_id, {MS} AS ts, upper(event_type) AS beacon, -(40 + value % 50) AS rssi FROM ev"))
def _(spark, sf):
    root = separate_files(spark, sf)
    return rd.read_tags_separate(spark, f"{root}/SAMPLES_TAGS_RSSI_*.csv")


@query("src_tags_both_layouts", "session_id:i w:t beacon:s rssi_cnt:i rssi_mean:f",
       with_ctes("""SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, beacon, count(*) AS rssi_cnt, avg(rssi) AS rssi_mean FROM (SELECT session_id, ts, beacon, rssi FROM tagc
         UNION ALL SELECT session_id, ts, upper(substr(md5(event_type), 1, 4)), -(40 + value % 50) FROM ev) GROUP BY 1, 2, 3"""))
def _(spark, sf):
    sep = raw_events(spark, sf).select("session_id", "ts", F.upper(F.substring(F.md5(F.col("event_type").cast("binary")), 1, 4)).alias("beacon"), "rssi")
    return win.rssi_window_agg(rd.tags_both_layouts(combined_file(spark, sf), sep), HOUR)


@query("src_matrix_wide", "session_id:i w:t beacon:s rssi_mean:f rssi_cnt:i coverage:f",
       with_ctes("""SELECT *, avg(rssi_cnt) OVER (PARTITION BY session_id, w) AS coverage FROM (SELECT g.session_id, g.w, b.beacon, avg(r.rssi) AS rssi_mean, CAST(count(r.rssi) > 0 AS INT) AS rssi_cnt
         FROM (SELECT DISTINCT session_id, w FROM rw) g JOIN (SELECT upper(beacon) AS beacon FROM beacons) b ON true LEFT JOIN (SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, upper(beacon) AS beacon, rssi FROM rssi) r
          ON r.session_id = g.session_id AND r.w = g.w AND r.beacon = b.beacon GROUP BY 1, 2, 3)"""))
def _(spark, sf):
    path = scratch_path(spark, "matrix")
    names = [b[0] for b in A.BEACON_ROWS]
    wide = raw_events(spark, sf).select("session_id", _text(F.col("ms")).alias("timestamp"), *[F.when(F.col("event_type") == n, _text(F.col("rssi"))).alias(n) for n in names])
    wide.write.partitionBy("session_id").option("header", True).csv(path)
    return rd.matrix_windows(rd.read_matrix_wide(spark, path, names), HOUR)


@query("src_packed_tags", "session_id:i ts:t beacon:s rssi:f",
       with_ctes("""SELECT session_id, ts, upper(event_type) AS beacon, -(40 + value % 50) AS rssi FROM ev
         UNION ALL SELECT session_id, ts, CASE event_id % 3 WHEN 0 THEN 'CA59' WHEN 1 THEN '1933' ELSE 'External_2' || CAST(event_id % 3 + 5 AS VARCHAR) END, -50 - event_id % 40 FROM ev
         UNION ALL SELECT session_id, ts, 'D7FD', -71 FROM ev WHERE event_id % 2 = 0"""))
def _(spark, sf):
    e = F.col("event_id")
    packed = F.concat(_text(-50 - e % 40), F.lit(" 2"), _text(e % 3 + 5), F.when(e % 2 == 0, "; -71 99 ;bad;x 25").otherwise(""))
    rows = raw_events(spark, sf).select("session_id", "ts", F.col("event_type").alias("uuid"), "rssi", packed.alias("info_other_tags"))
    codes = spark.createDataFrame([("25", "CA59"), ("26", "1933"), ("99", "D7FD")], "code string, beacon string")
    return rd.packed_tags(rows, codes)


@query("src_acc", "session_id:i ts:t magnitude:f",
       with_ctes(f"SELECT session_id, {MS} AS ts, sqrt(value * value + 4 * value * value + 1) AS magnitude FROM ev UNION ALL SELECT session_id, {MS}, 1 + value / 1000 FROM ev WHERE user_id % 5 <> 0"))
def _(spark, sf):
    raw = raw_events(spark, sf)
    a, b = scratch_path(spark, "acc"), scratch_path(spark, "accm")
    v = F.col("value")
    raw.select("session_id", _text(F.col("ms")), F.lit(""), _text(v), _text(v * 2), F.lit("1.0")).toDF("session_id", "a", "b", "x", "y", "z").write.partitionBy("session_id").csv(a)
    m = F.when(F.col("user_id") % 5 == 0, "?").otherwise(_text(1 + v / 1000))
    raw.select("session_id", _text(F.col("ms")).alias("timestamp"), m.alias("MAGNITUDE")).write.partitionBy("session_id").option("header", True).csv(b)
    return rd.read_acc(spark, a).unionByName(rd.read_acc(spark, b, ("timestamp", "MAGNITUDE"), header=True))


@query("src_steps", "session_id:i ts:t cnt:f", with_ctes(f"SELECT session_id, {MS} AS ts, cnt FROM steps"))
def _(spark, sf):
    path = scratch_path(spark, "steps")
    s = A.step_samples(spark, sf)
    s.select("session_id", _text(F.floor(F.unix_micros("ts") / 1000).cast("bigint")).alias("a"), F.lit("").alias("b"), _text(F.col("cnt")).alias("c")).write.partitionBy("session_id").csv(path)
    return rd.read_steps(spark, path)


@query("src_wearable_pressure", "session_id:i w:t pressure:f pressure_online:b",
       with_ctes("SELECT session_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, avg(hpa) AS pressure, true AS pressure_online FROM press GROUP BY 1, 2"))
def _(spark, sf):
    path = scratch_path(spark, "pressure")
    raw_events(spark, sf).select("session_id", _text(F.col("ms")).alias("timestamp"), _text(F.col("hpa")).alias("PRESSURE")).write.partitionBy("session_id").option("header", True).csv(path)
    return win.pressure_window_mean(rd.read_wearable_pressure(spark, path, ("timestamp", "PRESSURE"), header=True), HOUR)


@query("src_annotations", "session_id:i start:t end:t label:s sensor:s",
       with_ctes("""SELECT session_id, make_timestamp(epoch_us("start") // 1000 * 1000) AS "start", make_timestamp(epoch_us("end") // 1000 * 1000) AS "end", label, 'u' || CAST(user_id % 3 AS VARCHAR) AS sensor FROM ivl WHERE user_id % 4 <> 1 AND user_id % 5 <> 2"""))
def _(spark, sf):
    iv = A.intervals(spark, sf)
    ms = lambda c: F.floor(F.unix_micros(c) / 1000).cast("bigint")
    kind = F.when(F.col("user_id") % 4 == 1, "point").otherwise("timerange")
    key = F.when(F.col("user_id") % 5 == 2, "activityLevel").otherwise("location")
    shape = F.struct(
        ms("start").alias("start"), ms("end").alias("end"), kind.alias("type"), F.concat(F.lit("u"), _text(F.col("user_id") % 3)).alias("sensor"), F.create_map(key, F.col("label")).alias("data")
    )
    # one document per session and day, as recordings are annotated day by day
    docs = iv.select("session_id", F.to_date("start").alias("day"), shape.alias("shape")).groupBy("session_id", "day").agg(F.collect_list("shape").alias("shapes"))
    path = scratch_path(spark, "annotations")
    docs.select("session_id", "shapes").write.partitionBy("session_id").option("maxRecordsPerFile", 1).json(path)
    return ann.read_annotations(spark, path, "location")


cte(
    bmeta=f"""SELECT user_id AS session_id, upper(substr(md5(CAST(event_id % 50 AS VARCHAR)), 1, 4)) AS beacon, {NORMALISE_SQL} AS room FROM (SELECT user_id, event_id, {RAW_ROOM.format(s='VARCHAR')} AS t FROM events)""",
    bconf=f"""SELECT session_id, beacon, {NORMALISE_SQL} AS room FROM (SELECT user_id AS session_id, upper(substr(md5(CAST(event_id % 50 AS VARCHAR)), 1, 4)) AS beacon, min(t) AS t
      FROM (SELECT *, {RAW_ROOM.format(s='VARCHAR')} AS t FROM events) WHERE t IS NOT NULL GROUP BY 1, 2)""",
)


def beacon_docs(spark, sf):
    ev = A.events(spark, sf).withColumn("location", F.expr(RAW_ROOM.format(s="string")))
    bid = F.substring(F.md5(_text(F.col("event_id") % 50).cast("binary")), 1, 4)
    return ev.select(F.col("user_id").alias("session_id"), "event_id", bid.alias("beacon_id"), "location")


@query("src_beacon_metadata", "session_id:i beacon:s room:s",
       with_ctes("""SELECT session_id, beacon, room FROM bmeta WHERE room <> 'Unknown' UNION ALL
         SELECT session_id, beacon, room FROM bconf WHERE room <> 'Unknown' AND (session_id % 2 = 0 OR beacon IN (SELECT upper(substr(md5(CAST(k AS VARCHAR)), 1, 4)) FROM range(25) t(k)))"""))
def _(spark, sf):
    rows = beacon_docs(spark, sf)
    a, b = scratch_path(spark, "meta"), scratch_path(spark, "config")
    item = F.struct("beacon_id", "location", F.lit(0).cast("bigint").alias("start_date"), F.lit(0).cast("bigint").alias("end_date"))
    rows.groupBy("session_id", (F.col("event_id") % 50).alias("slot")).agg(F.collect_list(item).alias("beacons")).drop("slot").write.json(a)
    one = rows.filter("location is not null").groupBy("session_id", "beacon_id").agg(F.min("location").alias("location"))
    white = F.array(*[F.substring(F.md5(F.lit(str(k)).cast("binary")), 1, 4) for k in range(25)])
    one.select("session_id", F.create_map("beacon_id", "location").alias("tagsLocation"), white.alias("tagsWhitelist"), (F.col("session_id") % 2 == 1).alias("isWhitelistEnabled")).write.json(b)
    meta = rd.beacon_metadata(rd.read_json_docs(spark, a, rd.METADATA_SCHEMA))
    conf = rd.beacon_config(rd.read_json_docs(spark, b, rd.CONFIG_SCHEMA))
    return meta.unionByName(conf)


@query("src_beacon_pairs", "session_id:i beacon:s room:s",
       with_ctes("SELECT session_id, beacon, room FROM (SELECT * REPLACE (CASE WHEN session_id % 3 = 0 THEN 'ZZ' || beacon ELSE beacon END AS beacon) FROM bmeta) WHERE room <> 'Unknown' AND regexp_full_match(beacon, '[0-9A-F]{4}')"))
def _(spark, sf):
    rows = beacon_docs(spark, sf)
    bid = F.when(F.col("session_id") % 3 == 0, F.concat(F.lit("zz"), "beacon_id")).otherwise(F.concat(F.lit(" "), "beacon_id"))
    return rd.beacon_pairs(rows.select("session_id", "location", bid.alias("beacon")))


@query("src_mapping_resolve", "session_id:i beacon:s room:s",
       with_ctes("""SELECT coalesce(h.session_id, o.s) AS session_id, coalesce(h.beacon, o.b) AS beacon, coalesce(o.room, m.room, 'Beacon ' || coalesce(h.beacon, o.b)) AS room FROM (
           SELECT DISTINCT user_id AS session_id, upper(event_type) AS beacon FROM events) h FULL JOIN (SELECT DISTINCT user_id AS s, 'EXTRA' AS b, 'Office' AS room FROM events WHERE user_id % 10 = 0) o ON h.session_id = o.s AND h.beacon = o.b
         LEFT JOIN (SELECT upper(beacon) AS beacon, room FROM beacons WHERE beacon <> 'error') m ON m.beacon = h.beacon"""))
def _(spark, sf):
    ev = A.events(spark, sf).select(F.col("user_id").alias("session_id"), F.upper("event_type").alias("beacon"))
    mapped = ev.distinct().join(F.broadcast(A.beacons(spark).filter("beacon <> 'error'").select(F.upper("beacon").alias("beacon"), "room")), "beacon")
    extra = ev.filter(F.col("session_id") % 10 == 0).select("session_id", F.lit("EXTRA").alias("beacon"), F.lit("my office").alias("room")).distinct()
    return rd.resolve_mapping(ev, mapped, extra)


cte(
    dry=f"""SELECT session_id, "start", "end", label FROM (SELECT session_id, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS "start", CASE WHEN event_id % 13 = 0 THEN NULL ELSE make_timestamp(epoch_us(ts) // 1000000 * 1000000 + 900000000) END AS "end", {NORMALISE_SQL} AS label
      FROM (SELECT session_id, ts, event_id, {RAW_ROOM.format(s='VARCHAR')} AS t FROM ev)) WHERE "end" IS NOT NULL AND label <> 'Unknown'""",
)


@query("src_reference_diary", "session_id:i start:t end:t label:s",
       with_ctes("""SELECT session_id, "start", "end", label FROM (SELECT *, row_number() OVER (PARTITION BY session_id, time_bucket(INTERVAL 15 MINUTE, "start") ORDER BY "start", "end", label) AS r FROM dry) WHERE r = 1"""))
def _(spark, sf):
    ev = A.events(spark, sf)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    serial = (F.floor(F.unix_micros("ts") / 1_000_000) / 86_400.0 + 25569.0).cast("string")
    rows = ev.select(
        "session_id", F.when(F.col("event_id") % 2 == 0, text("ts")).otherwise(serial).alias("from_date"),
        F.when(F.col("event_id") % 13 == 0, "").otherwise(text(timefn.shift_ts("ts", 900))).alias("to_date"), F.expr(RAW_ROOM.format(s="string")).alias("Diary"),
    )
    path = scratch_path(spark, "diary")
    rows.write.option("header", True).parquet(path)
    return rd.reference_diary(spark.read.parquet(path), 900)


# -- sinks ---------------------------------------------------------------------
@query("sink_tables", "session_id:i participant:s windows:i corrected:i", with_ctes("SELECT session_id, 'p' || session_id AS participant, count(*) AS windows, count(corrected_room) AS corrected FROM slk GROUP BY 1"))
def _(spark, sf):
    """Timeline written by collection and participant, read back, counted."""
    t = locked(spark, sf).select("session_id", "w", "corrected_room", "main_sleep", F.concat(F.lit("p"), F.col("session_id")).alias("participant"), F.lit("c1").alias("collection"))
    root = scratch_path(spark, "tables")
    sinks.write_tables({"timeline": t}, root)
    back = spark.read.parquet(f"{root}/timeline")
    return back.groupBy("session_id", "participant").agg(F.count("*").alias("windows"), F.count("corrected_room").alias("corrected"))


@query("sink_merge_partial", "collection:i session:i n:i",
       "SELECT user_id % 5 AS collection, user_id AS session, CASE WHEN user_id % 5 IN (1, 3) THEN count(*) * 10 ELSE count(*) END AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    per = A.events(spark, sf).groupBy((F.col("user_id") % 5).alias("collection"), F.col("user_id").alias("session")).agg(F.count("*").alias("n"))
    current = per.filter("collection in (1, 3)").withColumn("n", F.col("n") * 10)
    return sinks.merge_partial(per, current, spark.createDataFrame([(1,), (3,)], "collection bigint"))
