"""Learning room labels from labelled windows: majority map, signatures, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from .topk import mode_label


def majority_calibration(train: DataFrame, test: DataFrame, keys: Sequence[str], beacon: str = "beacon", reference: str = "reference") -> DataFrame:
    """Predict the room most often seen with the beacon in training, else the
    overall mode. ``keys`` (data set, fold, …) separate models; the calibration
    table has one row per (keys, beacon)."""
    keys = list(keys)
    per_beacon = mode_label(train.filter(F.col(beacon).isNotNull()), [*keys, beacon], reference).select(*keys, beacon, F.col(reference).alias("_room"))
    overall = mode_label(train, keys, reference).select(*keys, F.col(reference).alias("_fallback"))
    return (
        test.join(per_beacon, [*keys, beacon], "left")
        .join(overall, keys, "left")
        .withColumn("predicted", F.coalesce("_room", "_fallback"))
        .drop("_room", "_fallback")
    )


def signature_match(
    train: DataFrame, test: DataFrame, keys: Sequence[str], row: Sequence[str] = ("row_id",), feature: str = "feature", value: str = "value", room: str = "room"
) -> DataFrame:
    """Nearest room signature by Euclidean distance, on long features.

    Features are standardised with training mean and sample deviation (constant
    features divide by 1); a room's signature is its median per feature. Missing
    values must be filled before. Ties go to the smaller room name.

    Statistics shuffle by (keys, feature); a row meets the signatures through
    its features, and the distance is one sum per (row, room)."""
    keys = list(keys)
    on = [*keys, feature]
    stats = train.groupBy(*on).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_sd"))
    scale = F.when(F.coalesce(F.col("_sd"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("_sd"))
    stats = stats.select(*on, "_m", scale.alias("_sd"))
    z = (F.col(value) - F.col("_m")) / F.col("_sd")
    signatures = train.join(stats, on).groupBy(*on, room).agg(F.percentile(z, F.lit(0.5)).alias("_sig"))
    scored = (
        test.drop(room).join(stats, on).withColumn("_z", z)
        .join(signatures, on)
        .groupBy(*keys, *row, room)
        .agg(F.sqrt(F.sum((F.col("_z") - F.col("_sig")) ** 2)).alias("distance"))
    )
    best = F.min_by(F.struct(room, "distance"), F.struct(F.round("distance", 9), F.col(room)))
    return scored.groupBy(*keys, *row).agg(best.alias("_b")).select(*keys, *row, F.col(f"_b.{room}").alias("predicted"), F.col("_b.distance").alias("distance"))


def group_kfold(rows: DataFrame, group: str, splits: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Assign whole groups to folds balanced by size: groups from the largest,
    each to the fold with the fewest rows so far (first one on ties).

    Only one (group, size) entry per group enters the sequential step, which
    folds over a sorted array per key; groups are calendar dates, so the array
    is as long as the recording has days."""
    keys = list(keys)
    sizes = rows.groupBy(*keys, group).agg(F.count("*").alias("_n"))
    packed = sizes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("neg"), F.col(group).cast("string").alias("g")))).alias("_gs"))
    k = F.least(F.size("_gs"), F.lit(splits))
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), k).alias("load"), F.array().cast("array<struct<g:string,fold:int>>").alias("out"))

    def place(acc, item):
        pos = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int")
        load = F.transform(acc["load"], lambda v, i: F.when(i == pos - 1, v - item["neg"]).otherwise(v))
        out = F.concat(acc["out"], F.array(F.struct(item["g"].alias("g"), pos.alias("fold"))))
        return F.struct(load.alias("load"), out.alias("out"))

    folds = packed.select(*keys, F.inline(F.aggregate("_gs", start, place, lambda acc: acc["out"])))
    assigned = sizes.withColumn("g", F.col(group).cast("string")).join(folds, [*keys, "g"]).select(*keys, group, "fold")
    return rows.join(assigned, [*keys, group])


def cross_validate_majority(rows: DataFrame, keys: Sequence[str], beacon: str = "beacon", reference: str = "reference") -> DataFrame:
    """Out-of-fold majority predictions for all folds in one job.

    Training counts of a fold are all counts minus the fold's own, so no row is
    copied per fold; only (keys, fold, beacon, room) counts are."""
    keys = list(keys)
    counts = rows.filter(F.col(beacon).isNotNull()).groupBy(*keys, "fold", beacon, reference).agg(F.count("*").alias("n"))
    folds = rows.select(*keys, "fold").distinct()
    other = counts.withColumnRenamed("fold", "_from")
    train = folds.join(other, keys).filter(F.col("fold") != F.col("_from"))
    per_beacon = mode_label(train, [*keys, "fold", beacon], reference, "n").select(*keys, "fold", beacon, F.col(reference).alias("_room"))
    overall = mode_label(train, [*keys, "fold"], reference, "n").select(*keys, "fold", F.col(reference).alias("_fallback"))
    return (
        rows.join(per_beacon, [*keys, "fold", beacon], "left")
        .join(overall, [*keys, "fold"], "left")
        .withColumn("predicted", F.coalesce("_room", "_fallback"))
        .drop("_room", "_fallback")
    )


def feature_set_sweep(long: DataFrame, sets: dict[str, Sequence[str]], keys: Sequence[str] = (), folds: Sequence[int] = (1, 2, 3, 4, 5), room: str = "room") -> DataFrame:
    """Signature matching for several feature sets and folds in one pass.

    ``long(keys…, row_id, fold, room, feature, family, value)``; a feature set is
    a list of families. Rows are copied to the sets that use their family, and
    for training to the other folds."""
    keys = list(keys)
    pairs = [F.struct(F.lit(name).alias("method"), F.lit(fam).alias("family")) for name, fams in sets.items() for fam in fams]
    table = long.sparkSession.range(1).select(F.inline(F.array(*pairs)))
    data = long.join(F.broadcast(table), "family")
    test = data.withColumn("test_fold", F.col("fold"))
    train = data.withColumn("test_fold", F.explode(F.filter(F.array(*[F.lit(int(f)) for f in folds]), lambda f: f != F.col("fold"))))
    return signature_match(train, test, [*keys, "method", "test_fold"], row=("row_id",), room=room)


def cluster_profiles(
    training: DataFrame, predicted: DataFrame, keys: Sequence[str], cluster: str = "cluster", features: Sequence[str] = (), missing: float = -100.0,
    means: Sequence[str] = ("samples", "gap_db", "steps"),
) -> DataFrame:
    """Per cluster: sizes, dominant (beacon, room) pair, mean signal per beacon
    with the missing value excluded, mean evidence."""
    on = [*keys, cluster]
    pair = F.struct(F.coalesce("beacon", F.lit("Missing")).alias("beacon"), F.coalesce("room", F.lit("Unmapped")).alias("room"))
    best = mode_label(training.withColumn("_pair", pair), on, "_pair").select(*on, F.col("_pair.beacon").alias("dominant_beacon"), F.col("_pair.room").alias("dominant_room"))
    stats = training.groupBy(*on).agg(
        F.count("*").alias("training_windows"), *[F.avg(m).alias(f"mean_{m}") for m in means],
        *[F.avg(F.when(F.col(f) != missing, F.col(f))).alias(f"mean_{f}") for f in features],
    )
    size = predicted.filter(F.col(cluster).isNotNull()).groupBy(*on).agg(F.count("*").alias("predicted_windows"))
    return stats.join(best, on).join(size, on, "left").na.fill(0, ["predicted_windows"])


def attach_cluster_room(predicted: DataFrame, profiles: DataFrame, keys: Sequence[str], cluster: str = "cluster", role: str = "session_id", unmapped: str = "Unmapped") -> DataFrame:
    """Cluster id → room, label and in-home flag."""
    on = [*keys, cluster]
    out = predicted.join(profiles.select(*on, "dominant_room"), on, "left")
    seen = F.col("has_rssi")
    room = F.when(seen & F.col("dominant_room").isNotNull(), F.col("dominant_room")).otherwise(unmapped)
    label = F.when(seen & F.col(cluster).isNotNull(), F.concat(F.col(role).cast("string"), F.lit("_C"), F.col(cluster).cast("string"))).otherwise(unmapped)
    return out.withColumns({"cluster_room": room, "cluster_label": label}).withColumn("in_home", F.col("cluster_room") != unmapped).drop("dominant_room")


def rssi_vector_features(cells: DataFrame, beacons: Sequence[str], beacon_rooms: DataFrame, steps: DataFrame, missing: float = -100.0, max_steps: float = 10.0) -> DataFrame:
    """One wide vector per window for a known beacon list plus strongest, gap,
    room, steps and the low-motion training flag."""
    from .topk import strongest_beacon

    keys = ["session_id", "w"]
    mine = cells.filter(F.col("beacon").isin(*beacons))
    wide = mine.groupBy(*keys).pivot("beacon", list(beacons)).agg(F.first("rssi_mean")).withColumnsRenamed({b: f"rssi_{b}" for b in beacons})
    wide = wide.na.fill(missing, [f"rssi_{b}" for b in beacons])
    top = strongest_beacon(mine, beacon_rooms).select(
        *keys, F.col("strongest_beacon").alias("beacon"), F.col("room"), "gap_db", F.col("rssi_sample_count").alias("samples"), F.col("rssi_observed").alias("has_rssi")
    )
    out = wide.join(top, keys).join(steps, keys, "left").na.fill(0, ["steps"])
    return out.withColumn("training", (F.col("steps") <= max_steps) & F.col("has_rssi"))


def largest_gap_split(values: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    """Split sorted values at the largest gap: ``group`` is ``lower`` or ``higher``.
    One row per (keys, item) — sensors of a home — enters the window."""
    order = Window.partitionBy(*keys).orderBy(value, item)
    gaps = values.withColumns({"_gap": F.round(F.col(value) - F.lag(value).over(order), 9), "_pos": F.row_number().over(order)})
    split = gaps.groupBy(*keys).agg(F.max_by("_pos", F.struct("_gap", -F.col("_pos"))).alias("_at"))
    return gaps.join(split, list(keys)).withColumn("group", F.when(F.col("_pos") < F.col("_at"), "lower").otherwise("higher")).drop("_gap", "_pos", "_at")
