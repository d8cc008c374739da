"""Running sums in value order and ranks, split over tasks for hot keys.

Values of a key are cut at approximate quantiles; each cut is its own window
partition and only the cut totals are ordered across the key. The cuts affect
how work is spread, never the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


CUTS = 64


def prefix_by_value(hist: DataFrame, keys: Sequence[str], value: str, sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums by ascending ``value``; ``hist`` has one row per
    (keys, value). ``sums`` maps output column → summed column."""
    keys = list(keys)
    probs = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    cuts = hist.groupBy(*keys).agg(F.percentile_approx(value, probs, 1000).alias("_cuts"))
    marked = hist.join(cuts, keys).withColumn(
        "_cut", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    ).drop("_cuts")
    totals = marked.groupBy(*keys, "_cut").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys, "_cut", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums]
    )
    inner = Window.partitionBy(*keys, "_cut").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = marked.withColumns({o: F.sum(c).over(inner) for o, c in sums.items()})
    out = out.join(totals, [*keys, "_cut"])
    out = out.withColumns({o: F.col(o) + F.col(f"_b_{o}") for o in sums})
    return out.drop("_cut", *[f"_b_{o}" for o in sums])


def pct_rank(df: DataFrame, keys: Sequence[str], value: str, output: str) -> DataFrame:
    """Average rank of ``value`` over the count of known values (0..1]; NULL for NULL."""
    keys = list(keys)
    added = not keys
    if added:
        df = df.withColumn("_all", F.lit(1))
        keys = ["_all"]
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = prefix_by_value(hist, keys, value, {"_upto": "_n"})
    total = hist.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ranks = upto.join(total, keys).select(
        *keys, value, ((F.col("_upto") - (F.col("_n") - 1) / 2) / F.col("_total")).alias(output)
    )
    out = df.join(ranks, [*keys, value], "left")
    return out.drop("_all") if added else out
