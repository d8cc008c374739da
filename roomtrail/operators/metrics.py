"""Agreement metrics from confusion counts.

Everything starts from ``confusion_counts``: one row per (keys, reference,
prediction). Rows are counted before any shuffle; what follows is as small as
the label set, so a method or data set with most of the rows is no hot spot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..env import durable

UNKNOWN = "Unknown"


def confusion_counts(predictions: DataFrame, keys: Sequence[str], reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    counts = predictions.groupBy(*keys, F.col(reference).alias("reference"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))
    return durable(counts)  # every metric reads the few counts more than once


def evaluable(counts: DataFrame) -> DataFrame:
    """Pairs with a reference and a usable prediction."""
    return counts.filter(F.col("reference").isNotNull() & F.col("prediction").isNotNull() & (F.col("prediction") != UNKNOWN))


def label_counts(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per label: rows with it as reference, as prediction, as both."""
    hit = F.when(F.col("reference") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("reference").alias("label"), F.col("n").alias("ref_n"), zero.alias("pred_n"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("prediction").alias("label"), zero.alias("ref_n"), F.col("n").alias("pred_n"), zero.alias("tp")),
    )
    return (
        pairs.select(*keys, F.inline(sides))
        .groupBy(*keys, "label")
        .agg(F.sum("ref_n").alias("ref_n"), F.sum("pred_n").alias("pred_n"), F.sum("tp").alias("tp"))
    )


def classification_metrics(predictions: DataFrame, keys: Sequence[str], reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """Windows, coverage, conditional and balanced accuracy, macro-F1 (union of
    labels, 0 where undefined) and end-to-end accuracy per ``keys``."""
    keys = list(keys)
    counts = confusion_counts(predictions, keys, reference, prediction)
    known = counts.filter("reference is not null")
    end_hit = F.when(F.col("reference") == F.coalesce("prediction", F.lit(UNKNOWN)), F.col("n")).otherwise(0)
    usable = F.col("prediction").isNotNull() & (F.col("prediction") != UNKNOWN)
    total = known.groupBy(*keys).agg(
        F.sum("n").alias("reference_windows"),
        F.sum(F.when(usable, F.col("n")).otherwise(0)).alias("evaluable_windows"),
        F.sum(F.when(usable & (F.col("reference") == F.col("prediction")), F.col("n")).otherwise(0)).alias("_tp"),
        F.sum(end_hit).alias("_end"),
    )
    labels = label_counts(evaluable(counts), keys)
    recall = F.when(F.col("ref_n") > 0, F.col("tp") / F.col("ref_n"))
    f1 = 2 * F.col("tp") / (F.col("ref_n") + F.col("pred_n"))
    per = labels.groupBy(*keys).agg(F.avg(recall).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))
    return (
        total.join(per, keys, "left")
        .withColumn("coverage", F.col("evaluable_windows") / F.col("reference_windows"))
        .withColumn("conditional_accuracy", F.when(F.col("evaluable_windows") > 0, F.col("_tp") / F.col("evaluable_windows")))
        .withColumn("end_to_end_accuracy", F.col("_end") / F.col("reference_windows"))
        .drop("_tp", "_end")
    )


def confusion_dense(predictions: DataFrame, keys: Sequence[str], reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """Counts for every pair of labels seen under ``keys``, zeros included. The
    label set is joined with itself on the keys; its size is the vocabulary's."""
    keys = list(keys)
    pairs = evaluable(confusion_counts(predictions, keys, reference, prediction))
    labels = label_counts(pairs, keys).select(*keys, "label")
    left = labels.withColumnRenamed("label", "reference")
    right = labels.withColumnRenamed("label", "prediction")
    return left.join(right, keys).join(pairs, [*keys, "reference", "prediction"], "left").na.fill(0, ["n"])


def recall_by_label(predictions: DataFrame, keys: Sequence[str], reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """Rows, recall and most common prediction per reference label."""
    counts = confusion_counts(predictions, keys, reference, prediction).filter("reference is not null")
    on = [*keys, "reference"]
    return counts.groupBy(*on).agg(
        F.sum("n").alias("windows"),
        (F.sum(F.when(F.col("reference") == F.col("prediction"), F.col("n")).otherwise(0)) / F.sum("n")).alias("recall"),
        F.expr("min_by(prediction, struct(-n, prediction)) filter (where prediction is not null)").alias("most_common_prediction"),
    )


def ppa_npa(predictions: DataFrame, keys: Sequence[str], reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """Positive and negative percent agreement per label, from label counts:
    negatives agreeing = rows that are neither referenced nor predicted as it."""
    keys = list(keys)
    counts = confusion_counts(predictions, keys, reference, prediction).filter("reference is not null and prediction is not null")
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_all"))
    lab = label_counts(counts, keys).join(total, keys)
    negative = F.col("_all") - F.col("ref_n")
    return lab.select(
        *keys, "label", F.col("ref_n").alias("positive_windows"), negative.alias("negative_windows"),
        F.when(F.col("ref_n") > 0, F.col("tp") / F.col("ref_n")).alias("ppa"),
        F.when(negative > 0, (negative - F.col("pred_n") + F.col("tp")) / negative).alias("npa"),
    )


def pairwise_agreement(wide: DataFrame, keys: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """Comparable rows and agreement for every ordered method pair; methods are
    columns, so each row yields one conditional count per pair."""
    aggs: list[Column] = []
    for a in methods:
        for b in methods:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            aggs.append(F.sum(both.cast("bigint")).alias(f"n|{a}|{b}"))
            aggs.append(F.sum((both & (F.col(a) == F.col(b))).cast("bigint")).alias(f"e|{a}|{b}"))
    flat = wide.groupBy(*keys).agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), F.col(f"`n|{a}|{b}`").alias("windows"), F.col(f"`e|{a}|{b}`").alias("equal"))
            for a in methods
            for b in methods
        ]
    )
    out = flat.select(*keys, F.inline(rows))
    agree = F.when(F.col("windows") > 0, F.col("equal") / F.col("windows"))
    return out.withColumns({"agreement_fraction": agree, "difference_fraction": 1 - agree}).drop("equal")


def predictions_long(wide: DataFrame, ids: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """One row per (row, method)."""
    return wide.unpivot(list(ids), list(methods), "method", "prediction")


def override_summary(df: DataFrame, keys: Sequence[str], reason: str = "reason", used: str = "override_used") -> DataFrame:
    """Count and share per reason, plus one total row of overrides used."""
    counts = df.groupBy(*keys, reason).agg(F.count("*").alias("windows"), F.sum(F.col(used).cast("bigint")).alias("_u"))
    total = Window.partitionBy(*keys)
    per = counts.withColumn("_all", F.sum("windows").over(total))
    used_row = per.groupBy(*keys).agg(F.sum("_u").alias("windows"), F.first("_all").alias("_all")).withColumn(reason, F.lit("cluster_override_used_total"))
    rows = per.select(*keys, reason, "windows", "_all").unionByName(used_row.select(*keys, reason, "windows", "_all"))
    return rows.withColumn("fraction", F.col("windows") / F.col("_all")).drop("_all")


def beacon_room_crosstab(labelled: DataFrame, keys: Sequence[str], beacon: str = "beacon", reference: str = "reference") -> DataFrame:
    """Beacon × room counts with the room a global majority mapping gives each
    beacon and the share of windows that mapping gets right."""
    counts = labelled.filter(F.col(beacon).isNotNull() & F.col(reference).isNotNull()).groupBy(
        *keys, F.col(beacon).alias("beacon"), F.col(reference).alias("reference")
    ).agg(F.count("*").alias("n"))
    per_beacon = Window.partitionBy(*keys, "beacon")
    all_rows = Window.partitionBy(*keys)
    mapped = F.min_by("reference", F.struct((-F.col("n")).alias("a"), F.col("reference").alias("b"))).over(per_beacon)
    out = counts.withColumn("mapped_room", mapped)
    hit = F.sum(F.when(F.col("reference") == F.col("mapped_room"), F.col("n")).otherwise(0)).over(all_rows)
    return out.withColumn("agreement", hit / F.sum("n").over(all_rows))


def evaluate_reference(timeline: DataFrame, reference: DataFrame, window_s: int, keys: Sequence[str] = ("session_id",)) -> tuple[DataFrame, DataFrame]:
    """Metrics and dense confusion of raw and corrected rooms against diary
    intervals; away windows count as ``Out`` in the corrected method.

    Returns (metrics, confusion) keyed by ``keys`` and method."""
    from .intervals import join_grid_interval

    aligned = join_grid_interval(timeline, reference, window_s)
    corrected = F.when(F.col("occupancy_state").isin("probable_away", "confirmed_away"), "Out").otherwise(F.col("corrected_room"))
    wide = aligned.select(
        *keys, "w", F.col("label").alias("reference"), F.col("raw_room").alias("raw_strongest_rssi"), corrected.alias("movement_supported_corrected")
    )
    long = predictions_long(wide, [*keys, "w", "reference"], ["raw_strongest_rssi", "movement_supported_corrected"])
    on = [*keys, "method"]
    return classification_metrics(long, on), confusion_dense(long, on)


def dataset_manifest(reference: DataFrame, rssi: DataFrame, steps: DataFrame, key: str = "session_id") -> DataFrame:
    """Per data set: reference, signal and step rows, beacons, label span."""
    a = reference.groupBy(key).agg(F.count("*").alias("reference_rows"), F.min("start").alias("first_label"), F.max("end").alias("last_label"))
    b = rssi.groupBy(key).agg(F.count("*").alias("rssi_rows"), F.count_distinct("beacon").alias("beacons"))
    c = steps.groupBy(key).agg(F.count("*").alias("step_rows"))
    return a.join(b, key, "full_outer").join(c, key, "full_outer").na.fill(0, ["reference_rows", "rssi_rows", "beacons", "step_rows"])


def metrics_by_band(predictions: DataFrame, band: str, means: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Metrics per confidence band with the band's share of rows and means."""
    base = classification_metrics(predictions, [*keys, band])
    sizes = predictions.groupBy(*keys, band).agg(F.count("*").alias("windows"), *[F.avg(m).alias(f"mean_{m}") for m in means])
    total = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    sizes = sizes.withColumn("band_coverage", F.col("windows") / F.sum("windows").over(total))
    return base.join(sizes, [*keys, band])


def metrics_by_threshold(predictions: DataFrame, steps: str, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Metrics over the rows with at most each number of steps. Each row is
    copied to the thresholds it passes; counting comes right after."""
    arr = F.array(*[F.lit(float(t)) for t in thresholds])
    passed = predictions.select("*", F.explode(F.filter(arr, lambda t: F.col(steps) <= t)).alias("step_threshold"))
    out = classification_metrics(passed, [*keys, "step_threshold"])
    total = predictions.filter("reference is not null").groupBy(*keys).agg(F.count("*").alias("total_labelled"))
    out = out.join(total, list(keys)) if keys else out.withColumn("total_labelled", total.scalar())
    return out.withColumn("threshold_coverage", F.col("reference_windows") / F.col("total_labelled"))


def correction_metrics(timeline: DataFrame, window_s: int, raw: str = "raw_room", corrected: str = "corrected_room") -> DataFrame:
    """Long table of session totals and hours per room before and after."""
    hours = window_s / 3600.0
    zero = F.lit(0).cast("double")
    base = timeline.groupBy("session_id").agg(
        F.count("*").cast("double").alias("total_windows"),
        F.sum(F.col(raw).isNull().cast("int")).cast("double").alias("raw_missing_windows"),
        F.sum(F.col(corrected).isNull().cast("int")).cast("double").alias("corrected_missing_windows"),
        F.sum((F.col(raw).isNull() & F.col(corrected).isNotNull()).cast("int")).cast("double").alias("filled_windows"),
        F.coalesce(F.avg((F.col(raw) == "Bedroom").cast("int")), zero).alias("raw_bedroom_fraction"),
        F.coalesce(F.avg((F.col(corrected) == "Bedroom").cast("int")), zero).alias("corrected_bedroom_fraction"),
    )
    metrics = [c for c in base.columns if c != "session_id"]
    totals = base.unpivot(["session_id"], metrics, "metric", "value").withColumn("room", F.lit(""))
    rooms = (
        timeline.select("session_id", F.inline(F.array(
            F.struct(F.lit("raw_hours").alias("metric"), F.col(raw).alias("room")),
            F.struct(F.lit("corrected_hours").alias("metric"), F.col(corrected).alias("room")),
        )))
        .filter("room is not null")
        .groupBy("session_id", "metric", "room")
        .agg((F.count("*") * hours).alias("value"))
    )
    return totals.unionByName(rooms)
