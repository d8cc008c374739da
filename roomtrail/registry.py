"""Registered queries: one Spark plan and, where SQL can say it, one oracle.

``out`` lists the result columns as ``name:kind``. Both sides are cast by it,
so that values compare exactly: ``i`` BIGINT, ``f`` DOUBLE rounded to 6
decimals, ``g`` DOUBLE rounded to 10 decimals (ratios of microseconds, where
6 would meet exact halves), ``t`` timestamp text, ``d`` date text, ``s`` text, ``b`` BOOLEAN.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .env import utc


@dataclass(frozen=True)
class Query:
    key: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _spec(out: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in out.split()]  # type: ignore[misc]


def _spark_cast(name: str, kind: str):
    c = F.col(name)
    if kind == "i":
        c = c.cast("bigint")
    elif kind == "f":
        c = F.round(c.cast("double"), 6) + F.lit(0.0)
    elif kind == "g":
        c = F.round(c.cast("double"), 10) + F.lit(0.0)
    elif kind == "t":
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif kind == "d":
        c = F.date_format(c, "yyyy-MM-dd")
    elif kind == "b":
        c = c.cast("boolean")
    else:
        c = c.cast("string")
    return c.alias(name)


def _sql_cast(name: str, kind: str) -> str:
    expr = {
        "i": f'CAST("{name}" AS BIGINT)',
        "f": f'round(CAST("{name}" AS DOUBLE), 6) + 0.0',
        "g": f'round(CAST("{name}" AS DOUBLE), 10) + 0.0',
        "t": f"strftime(\"{name}\", '%Y-%m-%d %H:%M:%S.%f')",
        "d": f"strftime(\"{name}\", '%Y-%m-%d')",
        "b": f'CAST("{name}" AS BOOLEAN)',
        "s": f'CAST("{name}" AS VARCHAR)',
    }[kind]
    return f'{expr} AS "{name}"'


def query(key: str, out: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``key``."""
    spec = _spec(out)
    oracle = None
    if sql is not None:
        cols = ", ".join(_sql_cast(n, k) for n, k in spec)
        oracle = f"SELECT {cols} FROM ({sql}) AS result"

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            utc(spark)
            return fn(spark, sf_dir).select(*[_spark_cast(n, k) for n, k in spec])

        if key in REGISTRY:
            raise ValueError(f"duplicate query {key}")
        REGISTRY[key] = Query(key, run, oracle)
        return fn

    return wrap
