"""Session settings, durable cut points and shared scratch space."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def utc(spark: SparkSession) -> SparkSession:
    """All timestamps in this library are instants read in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a session on one machine (``local`` master) may leave it unset; a
    temporary folder, removed at exit, then stands in for it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = tempfile.mkdtemp(prefix="roomtrail-")
        atexit.register(shutil.rmtree, _FALLBACK["dir"], ignore_errors=True)
    return _FALLBACK["dir"]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, never used twice."""
    return os.path.join(shared_dir(spark), f"roomtrail-{label}-{uuid.uuid4().hex}")


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a lost executor costs a read
    of the checkpoint and not the whole history of an iterative job. A table
    that is a checkpoint already is returned as it is, so operators that read an
    input several times can call this without knowing where it came from."""
    spark = df.sparkSession
    if df._jdf.queryExecution().logical().getClass().getSimpleName() == "LogicalRDD":
        return df
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
