"""Interval and nearest-time joins without nested loops.

An interval meets windows through the window starts it touches: exploding it to
those starts turns every range condition into a hash-partitioned equi-join. A
residual filter keeps exact bounds where points are not on the grid."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import bins, ceil_ts, floor_ts, seconds_between, shift_ts
from .ordered import Ordered


def overlap_seconds(intervals: DataFrame, window_s: int, label: Sequence[str] = ("label",)) -> DataFrame:
    """Seconds each label (tuple) covers of every window it touches."""
    touched = intervals.filter(F.col("start") < F.col("end")).select(
        "session_id", *label, "start", "end", F.explode(bins("start", "end", window_s)).alias("w")
    )
    seconds = seconds_between(F.greatest("start", "w"), F.least(F.col("end"), shift_ts("w", window_s)))
    return touched.withColumn("_s", seconds).filter("_s > 0").groupBy("session_id", "w", *label).agg(F.sum("_s").alias("seconds"))


def dominant_label(intervals: DataFrame, window_s: int, label: Sequence[str] = ("label",)) -> DataFrame:
    """Label with the most overlap per touched window; ties to the smallest."""
    cols = list(label)
    best = F.min_by(F.struct(*cols, "seconds"), F.struct((-F.round("seconds", 6)).alias("a"), *cols))
    picked = overlap_seconds(intervals, window_s, label).groupBy("session_id", "w").agg(best.alias("_b"))
    return picked.select(
        "session_id", "w", *[F.col(f"_b.{c}").alias(c) for c in cols], (F.col("_b.seconds") / window_s).alias("overlap_fraction")
    )


def join_overlap_majority(
    windows: DataFrame, intervals: DataFrame, window_s: int, min_fraction: float = 0.5, label: Sequence[str] = ("label",)
) -> DataFrame:
    """Windows with the label covering most of them, kept at ``min_fraction`` or more."""
    best = dominant_label(intervals, window_s, label).filter(F.col("overlap_fraction") >= min_fraction)
    return windows.join(best, ["session_id", "w"])


def join_overlap_dominant(grid: DataFrame, intervals: DataFrame, window_s: int, unknown: str = "Unknown") -> DataFrame:
    """Every grid window with its dominant label, no minimum."""
    best = dominant_label(intervals, window_s)
    return grid.join(best, ["session_id", "w"], "left").na.fill({"label": unknown, "overlap_fraction": 0.0})


def day_hour_matrix(hourly: DataFrame, label: str, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """(session, day) rows with one column per hour of day."""
    return (
        hourly.withColumns({"day": F.to_date("w"), "hour": F.hour("w")})
        .groupBy(*keys, "day")
        .pivot("hour", list(range(24)))
        .agg(F.first(label, ignorenulls=True))
        .withColumnsRenamed({str(h): f"h{h:02d}" for h in range(24)})
    )


def join_grid_interval(grid: DataFrame, intervals: DataFrame, window_s: int, sequence: str = "seq", closed: bool = False) -> DataFrame:
    """Label of the last interval (by ``sequence``) holding each grid time;
    bounds ``[start, end)`` or ``[start, end]``."""
    first = ceil_ts("start", window_s)
    times = F.explode(bins(first, F.col("end"), window_s, closed=closed))
    hits = intervals.select("session_id", times.alias("w"), F.struct(sequence, "label").alias("_l"))
    last = hits.groupBy("session_id", "w").agg(F.max("_l").alias("_l"))
    return grid.join(last, ["session_id", "w"], "left").withColumn("label", F.col("_l.label")).drop("_l")


def _winning(rows: list[tuple]) -> list[tuple]:
    """Sweep over one bin's clipped intervals (a, b, seq, label) in order of ``a``:
    (t, until, label) of segments that the same interval (the last by ``seq``, then
    label) covers throughout; label None in gaps, and one empty segment at the end."""
    held: list[tuple] = []  # kept sorted by (seq, label, end)
    out, k = [], 0
    times = sorted({x for a, b, _, _ in rows for x in (a, b)})
    for t, until in zip(times, [*times[1:], times[-1]]):
        while k < len(rows) and rows[k][0] <= t:
            _, b, seq, label = rows[k]
            insort(held, (seq, label, b))
            k += 1
        while held and held[-1][2] <= t:  # an ended one below the top is dropped when it surfaces
            held.pop()
        out.append((t, until, held[-1][1] if held else None))
    return out


def _sweep(batches: Iterator[pd.DataFrame], named: list[str]) -> Iterator[pd.DataFrame]:
    """Segments of all bins of a partition whose rows are sorted by (named, a)."""
    key, rows = None, []

    def made(done: list) -> pd.DataFrame:
        return pd.DataFrame([(*k, *x) for k, own in done for x in _winning(own)], columns=[*named, "t", "until", "label"])

    for batch in batches:
        done = []
        for new, row in zip(zip(*(batch[c] for c in named)), zip(batch["a"], batch["b"], batch["seq"], batch["label"])):
            if new != key:
                if rows:
                    done.append((key, rows))
                key, rows = new, []
            rows.append(row)
        yield made(done)
    yield made([(key, rows)] if rows else [])


def segments(clipped: DataFrame, named: Sequence[str]) -> DataFrame:
    """``clipped(named, a, b, seq, label)`` (numbers, a < b) as segments (named, t, until,
    label) without overlap, at most two per row of ``clipped``."""
    named = list(named)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in clipped.select(*named).schema)
    dealt = clipped.select(*named, "a", "b", "seq", "label").repartition(*named).sortWithinPartitions(*named, "a")
    return dealt.mapInPandas(lambda batches: _sweep(batches, named), f"{fields}t bigint, until bigint, label string")


def label_points(points: DataFrame, intervals: DataFrame, keys: Sequence[str], bin_s: int) -> DataFrame:
    """``points(keys, _t, ...)`` with ``label`` of the last interval that holds each.

    ``intervals(keys, start, end, seq, label)`` are clipped to bins and turned into
    segments that do not overlap, two per interval and bin at most; one ordered pass
    per bin carries a segment's label to its points. No pairs are made, so the work
    grows with points plus intervals however densely they lie."""
    keys, width = list(keys), bin_s * 1_000_000
    at = F.unix_micros("_bin")
    clipped = (
        intervals.withColumn("_bin", F.explode(bins("start", "end", bin_s)))
        .select(*keys, "_bin", F.greatest(F.unix_micros("start"), at).alias("a"), F.least(F.unix_micros("end"), at + width).alias("b"), "seq", "label")
    )
    named = [*keys, "_bin"]
    marks = segments(clipped, named).select(*named, F.col("t").alias("_us"), F.struct(F.col("label").alias("v")).alias("_seg"))
    probe = points.withColumn("_bin", floor_ts("_t", bin_s)).withColumn("_us", F.unix_micros("_t"))
    both = probe.withColumn("_seg", F.lit(None).cast(marks.schema["_seg"].dataType)).unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("_point", F.col("_seg").isNull())
    upto = Window.partitionBy(*named).orderBy("_us", "_point").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("label", F.last("_seg", ignorenulls=True).over(upto)["v"])
    return found.filter("_point").drop("_bin", "_us", "_seg", "_point")


def join_point_interval(
    points: DataFrame, intervals: DataFrame, point_key: Sequence[str], bin_s: int = 3600, sequence: str = "seq", ts: str = "ts"
) -> DataFrame:
    """Label of the last interval (by ``sequence``) holding each point, ``[start, end)``."""
    rows = intervals.select("session_id", "start", "end", F.col(sequence).alias("seq"), "label")
    return label_points(points.withColumn("_t", F.col(ts)), rows, ["session_id"], bin_s).drop("_t")


def join_scd_room(
    windows: DataFrame, validity: DataFrame, bin_s: int = 86_400, beacon: str = "beacon", sequence: str = "seq",
    unmapped: str = "Unmapped", output: str = "room",
) -> DataFrame:
    """Room of a beacon valid at the window time (``valid_from <= w < valid_to``,
    open when NULL); the last matching row wins.

    Open or long validity is clipped to the beacon's own first and last window,
    so the number of bins stays within the data."""
    on = ["session_id", beacon]
    span = windows.filter(F.col(beacon).isNotNull()).groupBy(*on).agg(F.min("w").alias("_a"), F.max("w").alias("_b"))
    end = F.coalesce("valid_to", shift_ts("_b", 1))
    rows = (
        validity.select("session_id", F.col("beacon").alias(beacon), F.col("room").alias("label"), F.col(sequence).alias("seq"), "valid_from", "valid_to")
        .join(span, on)
        .select(*on, F.greatest("valid_from", "_a").alias("start"), F.least(end, shift_ts("_b", 1)).alias("end"), "seq", "label")
    )
    out = label_points(windows.withColumn("_t", F.col("w")), rows, on, bin_s).drop("_t")
    return out.withColumn(output, F.coalesce("label", F.lit(unmapped))).drop("label")


def join_asof_nearest(
    left: DataFrame, right: DataFrame, values: Sequence[str], tolerance_s: float, ties: Sequence[str] = (), right_tie: str | None = None
) -> DataFrame:
    """Nearest row of ``right`` within ``tolerance_s``; at equal distance the
    earlier one. Both sides share (session_id, ts); ``ties`` are left columns
    that make its order unique.

    One union, one sort: the latest right row before and the earliest one after
    each left row are carried along, across time chunks too."""
    row = F.struct(F.col("ts").alias("t"), *values)
    order = F.col(right_tie).cast("bigint") if right_tie else F.lit(0).cast("bigint")
    r = right.select("session_id", "ts", F.lit(0).alias("_side"), order.alias("_o"), row.alias("_r"))
    l = left.withColumns({"_side": F.lit(1), "_o": F.lit(0).cast("bigint")})
    both = l.unionByName(r, allowMissingColumns=True)
    # right rows sort before left rows of the same time, so an exact match is "before"
    known = F.col("_side") == 0
    done = Ordered(both, ties=["_side", "_o", *ties]).apply(last_known={"_before": ("_r", known)}, next_known={"_after": ("_r", known)}).done()
    back = seconds_between(F.col("_before.t"), F.col("ts"))
    ahead = seconds_between(F.col("ts"), F.col("_after.t"))
    near = (
        F.when(back.isNotNull() & ((back <= ahead) | ahead.isNull()), F.when(back <= tolerance_s, F.col("_before")))
        .when(ahead <= tolerance_s, F.col("_after"))
    )
    out = done.filter("_side = 1").withColumn("_n", near)
    return out.withColumns({v: F.col(f"_n.{v}") for v in values}).drop("_side", "_o", "_r", "_before", "_after", "_n")


def join_episode_windows(timeline: DataFrame, episodes: DataFrame, window_s: int, columns: Sequence[str] = ("episode_id",), flag: str = "in_episode") -> DataFrame:
    """Attach episode columns to the windows inside ``[start, end)``; episodes of
    a session do not overlap."""
    inside = episodes.select("session_id", *columns, F.explode(bins("start", "end", window_s)).alias("w"), F.lit(True).alias(flag))
    return timeline.join(inside, ["session_id", "w"], "left").na.fill(False, [flag])


def join_shift_windows(timeline: DataFrame, shifts: DataFrame, window_s: int) -> DataFrame:
    """Flags for windows inside the support range (both ends included) of a
    supported and of an unsupported floor shift."""
    near = shifts.select("session_id", F.explode(bins("support_start", "support_end", window_s, closed=True)).alias("w"), "supported")
    flags = near.groupBy("session_id", "w").agg(
        F.bool_or("supported").alias("near_supported_shift"), F.bool_or(~F.col("supported")).alias("near_unsupported_shift")
    )
    return timeline.join(flags, ["session_id", "w"], "left").na.fill(False, ["near_supported_shift", "near_unsupported_shift"])


def join_gap_context(gaps: DataFrame, timeline: DataFrame, window_s: int, context_s: int = 1800, label: str = "beacon") -> DataFrame:
    """Observed windows and share of the target label in the time before and
    after each gap, clipped to the episode.

    ``gaps(session_id, gap_id, start, end, episode_start, episode_end, target)``."""
    keys = ["session_id", "gap_id"]
    lo = F.greatest(shift_ts("start", -context_s), F.col("episode_start"))
    hi = F.least(shift_ts("end", context_s), F.col("episode_end"))
    before = gaps.select(*keys, "target", F.explode(bins(lo, F.col("start"), window_s)).alias("w"), F.lit(True).alias("_before"))
    after = gaps.select(*keys, "target", F.explode(bins(F.col("end"), hi, window_s)).alias("w"), F.lit(False).alias("_before"))
    seen = timeline.filter(F.col(label).isNotNull()).select("session_id", "w", F.col(label).alias("_l"))
    hit = before.unionByName(after).join(seen, ["session_id", "w"])
    match = (F.col("_l") == F.col("target")).cast("int")
    agg = hit.groupBy(*keys).agg(
        F.count(F.when(F.col("_before"), 1)).alias("before_n"),
        F.avg(F.when(F.col("_before"), match)).alias("before_share"),
        F.count(F.when(~F.col("_before"), 1)).alias("after_n"),
        F.avg(F.when(~F.col("_before"), match)).alias("after_share"),
    )
    return gaps.join(agg, keys, "left").na.fill(0, ["before_n", "after_n"])


def join_pair_inner(timeline: DataFrame, pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two participants on equal windows, columns prefixed ``left_`` / ``right_``."""

    def side(name: str) -> DataFrame:
        member = pairs.select("pair_id", F.col(f"{name}_session").alias("session_id"))
        return timeline.join(member, "session_id").select("pair_id", "w", *[F.col(c).alias(f"{name}_{c}") for c in columns])

    return side("left").join(side("right"), ["pair_id", "w"])


def join_multi_method(grid: DataFrame, methods: dict[str, DataFrame], value: str, fill: str = "Unmapped") -> DataFrame:
    """Align methods on one grid, first row per time, one column per method."""
    out = grid
    for name, table in methods.items():
        order = [c for c in table.columns if c not in ("session_id", "w")]
        first = table.groupBy("session_id", "w").agg(F.min_by(value, F.struct(*order)).alias(name))
        out = out.join(first, ["session_id", "w"], "left")
    return out.na.fill(fill, list(methods))


def join_floor_cluster(fine: DataFrame, clusters: DataFrame, profiles: DataFrame, window_s: int = 1800) -> DataFrame:
    """Fine rows with the cluster row of the enclosing window and the cluster's
    profile. ``clusters(session_id, w, cluster, …)``, ``profiles(session_id, cluster, …)``."""
    coarse = clusters.join(profiles, ["session_id", "cluster"], "left").withColumnRenamed("w", "_w")
    return fine.withColumn("_w", floor_ts("w", window_s)).join(coarse, ["session_id", "_w"], "left").drop("_w")


def join_reference_windows(
    reference: DataFrame, sized: DataFrame, sizes_s: Sequence[int], default: str = "Out", ts: str = "start"
) -> DataFrame:
    """For each reference row the prediction, samples and gap of the window of
    every size holding its start; ``Out`` and 0 samples where there is none.

    ``sized(session_id, window_s, w, room, samples, gap_db)``."""
    from .windows import align_floor

    anchors = reference.select("session_id", F.col(ts).alias("w")).distinct()
    wide = align_floor(anchors, sized, sizes_s, ("room", "samples", "gap_db")).withColumnRenamed("w", ts)
    fill = {f"room_{s // 60}m": default for s in sizes_s} | {f"samples_{s // 60}m": 0 for s in sizes_s}
    return reference.join(wide, ["session_id", ts], "left").na.fill(fill)
