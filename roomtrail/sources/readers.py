"""Typed readers of raw exports. The caller names the variant and the schema is
explicit; malformed lines are dropped and bad numbers become NULL, then rows
without a time or value are left out. Nothing is sniffed from file contents.

A recording's session comes from the folder ``session_id=<n>`` it lies in, so
one scan reads every recording of a collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rooms import normalise_room
from ..functions.signal import magnitude
from ..functions.timefn import epoch_ts, excel_or_text_ts

HEX4 = "^[0-9A-F]{4}$"


def _csv(spark: SparkSession, path: str, columns: Sequence[str], header: bool) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    reader = spark.read.schema(schema).option("header", header).option("mode", "DROPMALFORMED").option("enforceSchema", not header)
    return reader.csv(path)


def _num(c: str):
    return F.trim(F.col(c)).try_cast("double")


def read_tags_combined(
    spark: SparkSession, path: str, columns: Sequence[str] = ("timestamp", "uuid", "rssi"), time: str = "timestamp", pressure: str | None = None
) -> DataFrame:
    """One headed file per recording with all beacons: (session_id, ts, beacon,
    rssi[, hpa]). ``columns`` lists the header in order."""
    raw = _csv(spark, path, columns, header=True)
    extra = [_num(pressure).alias("hpa")] if pressure else []
    out = raw.select("session_id", epoch_ts(F.col(time)).alias("ts"), F.upper(F.substring("uuid", 1, 4)).alias("beacon"), _num("rssi").alias("rssi"), *extra)
    return out.filter(F.col("ts").isNotNull() & F.col("rssi").isNotNull() & F.col("beacon").rlike(HEX4))


def read_tags_separate(spark: SparkSession, path: str) -> DataFrame:
    """One headless file (or folder of parts) per beacon, the id at the end of its
    name: ``…_<beacon>.csv``."""
    schema = "timestamp string, text string, rssi string"
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).csv(path)
    file = F.col("_metadata.file_path")
    beacon = F.upper(F.regexp_extract(file, r"_([0-9A-Za-z]+)\.csv(?:/[^/]*)*$", 1))
    session = F.regexp_extract(file, r"/session_id=([^/]+)/", 1).try_cast("bigint")
    out = raw.select(session.alias("session_id"), epoch_ts(F.col("timestamp")).alias("ts"), beacon.alias("beacon"), _num("rssi").alias("rssi"))
    return out.filter("ts is not null and rssi is not null")


def tags_both_layouts(combined: DataFrame, separate: DataFrame) -> DataFrame:
    """Both layouts of one recording as one sample stream; window sums and counts
    then add up before they are divided."""
    return combined.select("session_id", "ts", "beacon", "rssi").unionByName(separate.select("session_id", "ts", "beacon", "rssi"))


def read_matrix_wide(spark: SparkSession, path: str, beacons: Sequence[str], time: str = "timestamp") -> DataFrame:
    """Wide file (time, one column per beacon) in long form."""
    raw = _csv(spark, path, (time, *beacons), header=True)
    wide = raw.select("session_id", epoch_ts(F.col(time)).alias("ts"), *[_num(b).alias(b.upper()) for b in beacons]).filter("ts is not null")
    return wide.unpivot(["session_id", "ts"], [b.upper() for b in beacons], "beacon", "value")


def matrix_windows(long: DataFrame, window_s: int = 300) -> DataFrame:
    """Mean per (window, beacon), presence count and share of beacons present."""
    from pyspark.sql import Window

    from ..functions.timefn import floor_ts

    per = long.groupBy("session_id", floor_ts("ts", window_s).alias("w"), "beacon").agg(F.avg("value").alias("rssi_mean"))
    seen = F.col("rssi_mean").isNotNull().cast("int")
    return per.withColumn("rssi_cnt", seen).withColumn("coverage", F.avg(F.col("rssi_cnt")).over(Window.partitionBy("session_id", "w")))


def packed_tags(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Main readings plus the extra ones packed as ``"rssi code;rssi code"``.
    ``codes(code, beacon)`` translates; an unknown code keeps ``External_<code>``."""

    main = rows.select("session_id", "ts", F.upper("uuid").alias("beacon"), "rssi")
    item = rows.select("session_id", "ts", F.explode(F.split("info_other_tags", ";")).alias("item"))
    parts = item.select("session_id", "ts", F.split(F.trim("item"), r"\s+").alias("p")).filter(F.size("p") == 2)
    extra = parts.select("session_id", "ts", F.col("p")[0].try_cast("double").alias("rssi"), F.upper(F.col("p")[1]).alias("code")).filter("rssi is not null")
    named = extra.join(codes, "code", "left").withColumn("beacon", F.coalesce("beacon", F.concat(F.lit("External_"), F.col("code"))))
    return main.unionByName(named.select("session_id", "ts", "beacon", "rssi"))


def read_acc(spark: SparkSession, path: str, columns: Sequence[str] = ("timestamp", "text", "x", "y", "z"), header: bool = False) -> DataFrame:
    """Three axes, or a ``MAGNITUDE`` column: (session_id, ts, magnitude)."""
    raw = _csv(spark, path, columns, header)
    m = _num("MAGNITUDE") if "MAGNITUDE" in columns else magnitude(*[_num(c) for c in columns[-3:]])
    return raw.select("session_id", epoch_ts(F.col(columns[0])).alias("ts"), m.alias("magnitude")).filter("ts is not null and magnitude is not null")


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """Headless cumulative counter: (session_id, ts, cnt)."""
    raw = _csv(spark, path, ("timestamp", "text", "count"), header=False)
    return raw.select("session_id", epoch_ts(F.col("timestamp")).alias("ts"), _num("count").alias("cnt")).filter("ts is not null and cnt is not null")


def read_wearable_pressure(spark: SparkSession, path: str, columns: Sequence[str] = ("timestamp", "text", "pressure"), header: bool = False) -> DataFrame:
    raw = _csv(spark, path, columns, header)
    value = next(c for c in ("PRESSURE", "pressure", columns[-1]) if c in columns)
    return raw.select("session_id", epoch_ts(F.col(columns[0])).alias("ts"), _num(value).alias("hpa")).filter("ts is not null and hpa is not null")


def _rooms(rows: DataFrame) -> DataFrame:
    out = rows.select("session_id", F.upper(F.trim("beacon")).alias("beacon"), normalise_room("location").alias("room"))
    return out.filter((F.col("beacon") != "") & (F.col("room") != "Unknown"))


def beacon_metadata(docs: DataFrame) -> DataFrame:
    """``docs(session_id, beacons array<struct<beacon_id,location,…>>)`` → rooms."""
    return _rooms(docs.select("session_id", F.inline("beacons")).withColumnRenamed("beacon_id", "beacon"))


def beacon_config(docs: DataFrame) -> DataFrame:
    """``docs(session_id, tagsLocation map, tagsWhitelist array, isWhitelistEnabled)``
    → rooms; with an enabled whitelist only its members."""
    rows = docs.select("session_id", F.explode("tagsLocation").alias("beacon", "location"), "tagsWhitelist", "isWhitelistEnabled")
    listed = F.exists(F.coalesce("tagsWhitelist", F.array().cast("array<string>")), lambda b: F.upper(b) == F.upper(F.col("beacon")))
    return _rooms(rows.filter(~F.coalesce("isWhitelistEnabled", F.lit(False)) | listed))


METADATA_SCHEMA = "session_id bigint, timezone string, beacons array<struct<beacon_id:string,location:string,start_date:bigint,end_date:bigint>>"
CONFIG_SCHEMA = "session_id bigint, tagsLocation map<string,string>, tagsWhitelist array<string>, isWhitelistEnabled boolean, subjectTimezone string"


def read_json_docs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def beacon_pairs(rows: DataFrame) -> DataFrame:
    """(session_id, location, beacon) rows; ids of four hex characters only."""
    return _rooms(rows).filter(F.col("beacon").rlike(HEX4))


def resolve_mapping(beacons: DataFrame, mapped: DataFrame, override: DataFrame) -> DataFrame:
    """Room per (session, beacon): override, else mapping, else ``Beacon <id>``.
    ``beacons(session_id, beacon)`` are the ones heard; mapped ones stay too."""
    keys = ["session_id", "beacon"]
    o = override.select(*keys, normalise_room("room").alias("_o"))
    m = mapped.select(*keys, F.col("room").alias("_m"))
    out = beacons.select(*keys).distinct().join(m, keys, "full_outer").join(o, keys, "full_outer")
    return out.select(*keys, F.coalesce("_o", "_m", F.concat(F.lit("Beacon "), F.col("beacon"))).alias("room"))


def reference_diary(rows: DataFrame, one_per_s: int | None = None) -> DataFrame:
    """(session_id, from_date, to_date, Diary) text rows → intervals; rows without
    bounds or a known room are dropped. ``one_per_s`` keeps the first row of each
    start bucket."""
    out = rows.select(
        "session_id", excel_or_text_ts("from_date").alias("start"), excel_or_text_ts("to_date").alias("end"), normalise_room("Diary").alias("label")
    ).filter("start is not null and end is not null and label <> 'Unknown'")
    if one_per_s is None:
        return out
    from ..functions.timefn import floor_ts

    first = F.min_by(F.struct("start", "end", "label"), F.struct("start", "end", "label"))
    return out.groupBy("session_id", floor_ts("start", one_per_s).alias("_b")).agg(first.alias("r")).select("session_id", "r.start", "r.end", "r.label")
