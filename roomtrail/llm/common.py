"""Helpers shared by the operators: table reading, cut points, Arrow maps."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    A session without that setting may only be a local one (tests); it gets a
    folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="roomtrail-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 1 << 22


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in Arrow batches of about BATCH_BYTES (one row at least),
    unless the session names a bound itself.

    Spark's own bound is 10,000 rows or 64 MB, held outside the heap by each running task,
    with as much again while a batch grows, and once more by its worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query that is made and run inside go as soon as it ends, unless
    the session names the setting itself. For steps that end in ``cut``, which reads none again.

    Else they stay until the driver happens to collect its garbage, however many steps later.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = key in spark.conf.getAll
    if not own:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(key)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def plain(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns c0, c1, ... that no operator's own names meet, and its names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


def some(df: DataFrame, most: int, seed: int = 11) -> DataFrame:
    """All rows of ``df``, or a sample of about ``most`` where it has more: each row is
    kept with the same chance, so that what reaches the driver stays as small however
    many partitions there are."""
    total = df.count()
    return df if total <= most else df.sample(False, most / total, seed)


def arrow_map(df: DataFrame, columns: list[str], schema: str, rows: Callable[[pa.RecordBatch], dict[str, list]], by: str | None = None) -> DataFrame:
    """``mapInArrow`` of ``rows`` over ``columns``; ``rows`` gives lists by output column.

    With ``by`` a batch is cut into pieces of bounded bytes of that column.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string  # noqa: PLC2701

    spec: StructType = _parse_datatype_string(schema)
    target = to_arrow_schema(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, by) if by else [batch] if batch.num_rows else []:
                out = rows(piece)
                made = [x if isinstance(x := out[f.name], pa.Array) and x.type == f.type else pa.array(x, f.type) for f in target]
                yield pa.RecordBatch.from_arrays(made, schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``most`` bytes of ``column`` at most (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def star_edges(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(a, b)`` with ``b`` the
    smallest node of ``a``'s component, for every ``a`` other than ``b``.

    Alternating large-star and small-star rounds, each written to a reliable
    checkpoint, until the edge set stays the same. Null ends, loops and repeats
    are ignored; an empty input gives an empty result.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    now = cut(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(hi.alias("a"), lo.alias("b")).distinct())

    def seen(df: DataFrame):
        return df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()

    mark = seen(now)
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).union(joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = cut(small.distinct())
        was, mark = mark, seen(now)
        if was == mark:
            break
    return now


#: DuckDB table expression of one row: ``steps``, the 256 entries made from the polynomial of CRC-32.
CRC32_STEPS = "(SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps FROM range(256) r(i))"


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes as a DuckDB expression, one step a byte,
    where ``steps`` of CRC32_STEPS is in reach."""
    code = f"list_transform(range(length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {code}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"
