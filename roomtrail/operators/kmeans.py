"""K-means of every key's vectors at once, as grouped DataFrame steps.

Seeds are deterministic (the first row, then the row farthest from all seeds so far),
and Lloyd steps run until no centre of any key moves, so a key's clusters depend on
its own rows alone and not on chance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..env import durable

STEPS_PER_JOB = 4


def standardised(rows: DataFrame, keys: Sequence[str], features: Sequence[str], output: str = "z", training: Column | None = None) -> DataFrame:
    """``rows`` with an array of the features, centred and scaled by their key's mean and
    deviation over ``training`` rows; a constant feature is zero."""
    use = F.lit(True) if training is None else training
    stats = [F.struct(F.avg(F.when(use, F.col(c))).alias("m"), F.stddev_pop(F.when(use, F.col(c))).alias("s")) for c in features]
    moments = rows.groupBy(*keys).agg(*[s.alias(f"_m{i}") for i, s in enumerate(stats)])
    z = [F.when(F.col(f"_m{i}.s") > 0, (F.col(c) - F.col(f"_m{i}.m")) / F.col(f"_m{i}.s")).otherwise(0.0) for i, c in enumerate(features)]
    return rows.join(moments, list(keys)).withColumn(output, F.array(*z)).drop(*[f"_m{i}" for i in range(len(features))])


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def nearest(z: Column, centers: Column) -> Column:
    """1-based number of the nearest centre; ties go to the first."""
    d = F.transform(centers, lambda c: squared_distance(c, z))
    return F.array_position(d, F.array_min(d)).cast("int")


def fit(rows: DataFrame, keys: Sequence[str], ks: Sequence[int], size: int, order: Sequence[str], z: str = "z", rounds: int = 400) -> DataFrame:
    """(keys, k, centers, converged) for every key of ``rows`` and each of ``ks``.
    ``size`` is the length of the vectors, ``order`` columns that make a key's rows
    unique. Keys with fewer than k distinct vectors get as many centres as they have.

    The seeds of fewer clusters are the first seeds of more; all models step together."""
    keys, on = list(keys), [*keys, "k"]
    own = durable(rows.select(*keys, F.struct(*order).alias("_o"), F.col(z).alias("_z")))
    seeds = own.groupBy(*keys).agg(F.array(F.min_by("_z", "_o")).alias("centers"))
    for i in range(1, max(ks)):
        gap = F.array_min(F.transform("centers", lambda c: squared_distance(c, F.col("_z"))))
        far = own.join(seeds, keys).withColumn("_d", F.round(gap, 9)).filter("_d > 0")
        far = far.groupBy(*keys).agg(F.min_by("_z", F.struct((-F.col("_d")).alias("d"), "_o")).alias("_new"))
        seeds = seeds.join(far, keys, "left").withColumn("centers", F.when(F.col("_new").isNull(), F.col("centers")).otherwise(F.array_append("centers", F.col("_new")))).drop("_new")
        if i % STEPS_PER_JOB == 0:
            seeds = durable(seeds)
    model = seeds.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).withColumn("centers", F.slice("centers", F.lit(1), F.col("k")))
    model = durable(model.withColumn("converged", F.lit(False)))
    for _ in range(0, rounds, STEPS_PER_JOB):
        for _ in range(STEPS_PER_JOB):
            seen = own.join(model.filter("not converged").select(*on, "centers"), keys).withColumn("_l", nearest(F.col("_z"), F.col("centers")))
            mean = F.array(*[F.avg(F.col("_z")[i]) for i in range(size)])
            per = seen.groupBy(*on, "_l").agg(mean.alias("_c"))
            new = per.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("_l", "_c"))).alias("_new"))
            moved = F.transform("centers", lambda c, i: F.coalesce(F.try_element_at("_new", i + 1), c))
            still = F.forall(F.zip_with(moved, F.col("centers"), squared_distance), lambda d: d < 1e-18)
            model = model.join(new, on, "left").select(
                *on, F.when(F.col("_new").isNull(), F.col("centers")).otherwise(moved).alias("centers"), (F.col("converged") | F.col("_new").isNull() | still).alias("converged")
            )
        model = durable(model)
        if model.filter("not converged").isEmpty():
            break
    return model


def silhouette(rows: DataFrame, keys: Sequence[str], label: str, size: int, z: str = "z") -> DataFrame:
    """(keys, silhouette, smallest, clusters): the mean squared-Euclidean silhouette of
    labelled vectors, from each cluster's count, mean and mean squared norm; members of
    clusters of one score 0. ``smallest`` is the size of the smallest cluster."""
    keys = list(keys)
    norm = squared_distance(F.col(z), F.transform(F.col(z), lambda _: F.lit(0.0)))
    stats = rows.groupBy(*keys, label).agg(F.count("*").alias("n"), F.array(*[F.avg(F.col(z)[i]) for i in range(size)]).alias("m"), F.avg(norm).alias("q"))
    packed = stats.groupBy(*keys).agg(F.collect_list(F.struct(F.col(label).alias("l"), "n", "m", "q")).alias("_s"), F.min("n").alias("smallest"), F.count("*").alias("clusters"))
    # mean squared distance of a point to a cluster's members
    to = lambda s: norm + s["q"] - 2 * F.aggregate(F.zip_with(s["m"], F.col(z), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    wide = rows.join(packed, keys)
    mine = F.filter("_s", lambda s: s["l"] == F.col(label))[0]
    a = to(mine) * mine["n"] / (mine["n"] - 1)
    b = F.array_min(F.transform(F.filter("_s", lambda s: s["l"] != F.col(label)), to))
    top = F.greatest(a, b)
    score = F.when((mine["n"] == 1) | b.isNull(), 0.0).otherwise(F.when(top > 0, (b - a) / top).otherwise(0.0))
    return wide.withColumn("_score", score).groupBy(*keys).agg(F.avg("_score").alias("silhouette"), F.first("smallest").alias("smallest"), F.first("clusters").alias("clusters"))
