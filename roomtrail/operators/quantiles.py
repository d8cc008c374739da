"""Exact quantiles of very large groups.

``percentile`` keeps every distinct value of a group in one aggregation
buffer. That is right for values with few distinct levels or for groups that
are already aggregated to windows. For raw continuous samples,
``exact_quantiles`` finds a narrow bracket with the mergeable sketch behind
``percentile_approx`` and ranks only the bracket's values; the answer is the
exact, linearly interpolated quantile. The input is read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SKETCH_ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    outputs: dict[str, float],
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """One row per ``keys`` with a column per entry of ``outputs`` (name → probability)."""
    keys = list(keys)
    margin = 3.0 / accuracy
    probs = list(outputs.values())
    lows = F.array(*[F.lit(max(p - margin, 0.0)) for p in probs])
    highs = F.array(*[F.lit(min(p + margin, 1.0)) for p in probs])
    raw = df.filter(F.col(value).isNotNull())
    bracket = raw.groupBy(*keys).agg(
        F.count("*").alias("_total"),
        F.percentile_approx(value, lows, accuracy).alias("_lo"),
        F.percentile_approx(value, highs, accuracy).alias("_hi"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
    )
    # up to ``accuracy`` values the margin may be less than a rank: rank them all
    few = F.col("_total") <= accuracy
    bracket = bracket.withColumns(
        {
            "_lo": F.when(few, F.array_repeat("_min", len(probs))).otherwise(F.col("_lo")),
            "_hi": F.when(few, F.array_repeat("_max", len(probs))).otherwise(F.col("_hi")),
        }
    )
    slots = F.array(*[F.lit(i) for i in range(len(probs))])
    per_prob = bracket.select(
        *keys,
        "_total",
        F.explode(slots).alias("_slot"),
        "_lo",
        "_hi",
    ).select(
        *keys,
        "_slot",
        F.element_at("_lo", F.col("_slot") + 1).alias("_lo"),
        F.element_at("_hi", F.col("_slot") + 1).alias("_hi"),
        (F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_slot") + 1) * (F.col("_total") - 1)).alias("_rank"),
    )
    joined = raw.select(*keys, F.col(value).alias("_v")).join(per_prob, keys).filter(F.col("_v") <= F.col("_hi"))
    # one count stands for everything below the bracket; duplicates collapse
    # before anything is ranked
    inside = joined.groupBy(*keys, "_slot", "_rank", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys, "_slot").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_upto", F.sum("_n").over(order)).withColumn("_from", F.col("_upto") - F.col("_n"))
    low_rank, high_rank = F.floor("_rank"), F.ceil("_rank")

    def at(rank):
        hit = (F.col("_from") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(hit, F.col("_v")))

    picked = ranked.groupBy(*keys, "_slot").agg(
        at(low_rank).alias("_a"), at(high_rank).alias("_b"), F.first("_rank").alias("_rank")
    )
    value_at = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rank") - F.floor("_rank"))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_slot") == i, value_at)).alias(name) for i, name in enumerate(outputs)]
    )
