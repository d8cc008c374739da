"""Canonical sensor tables derived from the driver's ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ordered import Ordered

# Event type → room, floor (stand-in for a home's beacon list).
BEACON_ROWS = [
    ("click", "Bedroom", "2F"),
    ("error", "Office", "2F"),
    ("purchase", "Kitchen", "1F"),
    ("signup", "Bathroom", "2F"),
    ("view", "Living", "1F"),
]
WINDOW_S = 3600


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver parquet stores naive timestamps; they are read as UTC instants."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        (F.col("user_id") % 4).alias("session_id"),
    )


def rssi_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "session_id", "ts", F.col("event_type").alias("beacon"), (-(F.lit(40) + F.col("value") % 50)).alias("rssi")
    )


def acc_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("session_id", "ts", (F.lit(1) + F.col("value") / 1000).alias("magnitude"))


def step_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counter that wraps at 5000."""
    ev = events(spark, sf_dir).select("session_id", "ts", "event_id", F.floor("value").cast("bigint").alias("inc"))
    run = Ordered(ev, ties=["event_id"]).running_sum(total="inc").done()
    return run.select("session_id", "ts", "event_id", (F.col("total") % 5000).cast("double").alias("cnt"))


def pressure_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "session_id", "ts", "event_id", F.col("event_type").alias("sensor"), (F.lit(1000) + F.col("value") % 10).alias("hpa")
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select(
        "session_id", "event_id", F.col("ts").alias("start"), F.col("event_type").alias("label"), "user_id"
    )
    led = Ordered(ev, ts="start", ties=["event_id"]).lead(end="start").done()
    return led.filter("end is not null").select("session_id", "event_id", "start", "end", "label", "user_id")


def beacons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BEACON_ROWS, "beacon string, room string, floor string")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference = event type, prediction = the one before it in the session."""
    ev = events(spark, sf_dir).select("session_id", "ts", "event_id", F.col("event_type").alias("reference"), "value")
    return Ordered(ev, ties=["event_id"]).lag(prediction="reference").done()


def pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 0, 1), (1, 2, 3)], "pair_id bigint, left_session bigint, right_session bigint")
