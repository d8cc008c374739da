"""Writing result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("collection", "participant"), fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A result table partitioned for pruning. With ``mode='overwrite'`` and
    dynamic partition overwrite only the partitions present are replaced."""
    parts = [c for c in partition_by if c in df.columns]
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*parts) if parts else writer).format(fmt).save(path)


def write_tables(tables: dict[str, DataFrame], root: str, partition_by: Sequence[str] = ("collection", "participant"), fmt: str = "parquet") -> None:
    for name, df in tables.items():
        write_table(df, f"{root}/{name}", partition_by, fmt)


def merge_partial(existing: DataFrame, current: DataFrame, selected: DataFrame, key: str = "collection") -> DataFrame:
    """A re-run of some collections keeps the other collections' rows."""

    kept = existing.join(selected.select(key).distinct(), key, "left_anti")
    return kept.unionByName(current, allowMissingColumns=True)


def local_timeline(timeline: DataFrame, sessions: DataFrame) -> DataFrame:
    """Session columns and local time added for export."""
    cols = [c for c in sessions.columns if c not in ("session_id", "timezone")]
    out = timeline.join(sessions.select("session_id", "timezone", *cols), "session_id")
    return out.withColumn("time_local", F.from_utc_timestamp("w", F.col("timezone")))
