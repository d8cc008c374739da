"""Exact dedup in DataFrame functions only, frequent texts apart from the others.

A Misra-Gries sketch of the digests names every text that could hold a large share
of all rows; a second pass counts these exactly. The verified ones fit into a
broadcast, by which their copies are judged where they lie. All other texts have few
copies each and meet by an ordinary shuffle of ids and digests. Texts themselves are
never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, plain

#: Counters of the sketch, and so the most texts that are broadcast (64 bytes each).
COUNTERS = 4096
#: Sketches that are merged at a time.
FAN_IN = 64


def digest(text: Column) -> Column:
    """SHA-256 of a text as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _item(digests: Column) -> Column:
    """What the sketch counts: a long made of a digest. Digests that share one are
    told apart by the exact count that follows."""
    return F.xxhash64(digests)


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``(_item)``: the at most ``counters`` candidates of the sketch of
    ``digests(digest)``, with every item in more than about 7 / ``counters`` of all
    rows among them. Sketches are merged FAN_IN at a time, so that no task meets more
    than that many, however many partitions there are."""
    level = digests.select(_item(F.col("digest")).alias("_item"), F.spark_partition_id().alias("_part")).groupBy("_part").agg(F.expr(f"approx_top_k_accumulate(_item, {counters})").alias("_sketch"))
    for _ in range(4):  # one sketch is left of up to FAN_IN ** 4 partitions
        level = level.groupBy(F.floor(F.col("_part") / FAN_IN).alias("_part")).agg(F.expr(f"approx_top_k_combine(_sketch, {counters})").alias("_sketch"))
    return level.select(F.explode(F.expr(f"approx_top_k_estimate(_sketch, {counters}).item")).alias("_item")).filter("_item IS NOT NULL")


def _judged(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows(doc_id, row, ...)`` marked by ``columns`` ``last`` (the row that stays) and ``n``."""
    return rows.select("doc_id", "digest", columns["last"]["doc_id"].alias("keep_id"), columns["n"].alias("group_size"), (columns["last"]["row"] == F.col("row")).alias("kept"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``(doc_id, digest, keep_id, group_size, kept)`` for every row of ``docs``.

    Rows with the same text form a group, of which the row with the largest id stays;
    null ids are less than all others, and of several rows with that id one stays.
    Null texts count as empty. ``keep_id`` is null only where the whole group has null
    ids. Other columns are not read; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    # Row numbers are kept with the digests: no later step gives them anew.
    rows = cut(base.withColumn("row", F.monotonically_increasing_id()))
    order = F.struct("doc_id", "row")
    if rows.isEmpty():
        return _judged(rows, {"last": order, "n": F.lit(1).cast("long")})
    few = F.broadcast(cut(frequent(rows, counters)))  # at most ``counters`` rows
    share = F.lit(rows.count() // counters)
    counted = rows.join(few, _item(F.col("digest")) == F.col("_item"), "left_semi").groupBy("digest").agg(F.count("*").alias("_n"), F.max(order).alias("_last"))
    # At most ``counters`` texts can have more rows than that share.
    heavy = F.broadcast(cut(counted.filter(F.col("_n") > share)))
    removed = rows.join(heavy, "digest")
    rest = rows.join(heavy.select("digest"), "digest", "left_anti")
    group = Window.partitionBy("digest")
    met = rest.withColumns({"_n": F.count("*").over(group), "_last": F.max(order).over(group)})
    verdict = {"last": F.col("_last"), "n": F.col("_n")}
    return _judged(removed, verdict).unionByName(_judged(met, verdict))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, with all its columns: the
    row with the largest id. Rules for nulls and repeated rows as in :func:`classes`."""
    own, columns = plain(docs)
    name = dict(zip(columns, own.columns, strict=True))
    stays = classes(docs, id_col, text_col, counters).filter("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    marked = own.withColumns({"_own": digest(F.col(name[text_col])), "_key": F.col(name[id_col]).cast("long")})
    found = marked.join(stays, (F.col("_own") == F.col("_digest")) & F.col("_key").eqNullSafe(F.col("_id")), "left_semi")
    return found.dropDuplicates(["_own"]).select(*own.columns).toDF(*columns)


def oracle() -> str:
    return """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
      sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
