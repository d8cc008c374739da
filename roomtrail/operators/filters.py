"""Row filters and small projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Evidence tag → confidence class.
CONFIDENCE_OF_EVIDENCE = {
    "observed_raw": "observed",
    "awake_adaptive": "supported_inference",
    "sleep_episode_locked": "supported_inference",
    "sleep_gap_context_filled": "supported_inference",
    "missing": "missing",
}
RSSI_FILL = -110.0


def allowed_beacons(tags: DataFrame, beacons: DataFrame | None) -> DataFrame:
    """Keep tags whose first four uuid characters are hexadecimal and, when a
    beacon list is given, on it."""
    out = tags.withColumn("beacon", F.upper(F.substring("uuid", 1, 4))).filter(F.col("beacon").rlike("^[0-9A-F]{4}$"))
    if beacons is None:
        return out
    on = [c for c in ("session_id", "beacon") if c in beacons.columns]
    return out.join(beacons.select(*on), on, "left_semi")


def active_beacons(validity: DataFrame, recording: DataFrame) -> DataFrame:
    """Beacon rows whose validity overlaps the recording of their session.
    ``recording`` has one row (session_id, start, end) per session."""
    rec = recording.select("session_id", F.col("start").alias("_a"), F.col("end").alias("_b"))
    overlap = (F.col("valid_from") < F.col("_b")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("_a")))
    return validity.join(rec, "session_id").filter(overlap).drop("_a", "_b")


def capability(sessions: DataFrame, sensors: dict[str, DataFrame]) -> DataFrame:
    """One row per session with ``has_<sensor>`` flags. Sensor tables shrink to
    distinct sessions before they meet."""
    marks = None
    for name, table in sensors.items():
        m = table.select("session_id").distinct().withColumn("_sensor", F.lit(name))
        marks = m if marks is None else marks.unionByName(m)
    flags = marks.groupBy("session_id").agg(
        *[F.bool_or(F.col("_sensor") == name).alias(f"has_{name}") for name in sensors]
    )
    cols = [f"has_{name}" for name in sensors]
    return sessions.join(flags, "session_id", "left").na.fill(False, cols)


def location_provenance(timeline: DataFrame, raw: str = "raw_beacon", corrected: str = "corrected_beacon") -> DataFrame:
    """Confidence class of the evidence and whether the beacon was changed."""
    out = F.lit("uncertain")
    for tag, label in reversed(CONFIDENCE_OF_EVIDENCE.items()):
        out = F.when(F.col("location_evidence") == tag, label).otherwise(out)
    return timeline.withColumn("location_confidence", out).withColumn(
        "was_corrected", F.coalesce(corrected, F.lit("")) != F.coalesce(raw, F.lit(""))
    )


def fill_features(
    df: DataFrame,
    rssi_prefixes: Sequence[str] = ("mean_", "median_", "max_"),
    other: dict[str, float] | None = None,
    keys: Sequence[str] = ("session_id", "w"),
    rssi_fill: float = RSSI_FILL,
) -> DataFrame:
    """Missing signal levels → a very weak level, other features → 0, unless
    ``other`` names a value."""
    fill = {}
    for c, kind in df.dtypes:
        if c in keys or kind not in ("double", "float", "int", "bigint"):
            continue
        fill[c] = (other or {}).get(c, rssi_fill if c.startswith(tuple(rssi_prefixes)) else 0.0)
    return df.na.fill(fill)
