"""Annotation JSON: interval shapes in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPE = "struct<start:bigint,end:bigint,type:string,sensor:string,data:map<string,string>>"
FILE_SCHEMA = f"shapes array<{SHAPE}>"


def _intervals(shapes: DataFrame, key: str) -> DataFrame:
    """Time-range shapes that carry ``data.<key>`` as (start, end, label, sensor)."""
    label = F.col("shape.data")[key]
    return shapes.filter((F.col("shape.type") == "timerange") & label.isNotNull()).withColumns(
        {
            "start": F.timestamp_millis(F.col("shape.start")),
            "end": F.timestamp_millis(F.col("shape.end")),
            "label": label,
            "sensor": F.col("shape.sensor"),
        }
    ).drop("shape")


def read_annotations(spark: SparkSession, path: str, key: str = "location") -> DataFrame:
    """One JSON document per file; the session is named by its folder
    ``session_id=<n>`` (partition column)."""
    docs = spark.read.schema(FILE_SCHEMA).option("multiLine", True).json(path)
    keep = [c for c in docs.columns if c != "shapes"]
    return _intervals(docs.select(*keep, F.explode("shapes").alias("shape")), key)


def write_shapes(shapes: DataFrame, path: str) -> None:
    """One shape per line, foldered by session: no session is gathered into one
    document by one task."""
    shapes.select("session_id", F.col("shape").alias("value")).write.partitionBy("session_id").text(path)


def read_shape_lines(spark: SparkSession, path: str, key: str = "location") -> DataFrame:
    """Shapes as written by :func:`write_shapes`."""
    lines = spark.read.option("basePath", path).text(path)
    return _intervals(lines.select("session_id", F.from_json("value", SHAPE).alias("shape")), key)
