"""Two people: shared grid, co-presence states, summaries, method comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..env import durable
from ..functions.timefn import bins
from .intervals import join_pair_inner, segments
from .windows import grid_common

# Co-presence states in report order with their labels.
STATES = {
    "both_in_home_same_location": "Same location",
    "both_in_home_different_location": "Different locations",
    "subject_in_home_study_partner_away_or_unmapped": "Subject home only",
    "study_partner_in_home_subject_away_or_unmapped": "Study-partner home only",
    "both_away_or_unmapped": "Both away/unmapped",
}


def copresence_pair(timeline: DataFrame, pairs: DataFrame, window_s: int = 300) -> tuple[DataFrame, DataFrame]:
    """Raw and corrected same-room flags and their counts per stratum plus ``all``.

    A missing room never equals a missing room; the corrected flag needs both
    people indoors. Stratum precedence: unknown > away > sleep > awake."""
    cols = ["raw_room", "corrected_room", "occupancy_state", "behaviour_state"]
    m = join_pair_inner(timeline, pairs, cols)
    indoor = F.col("left_occupancy_state").startswith("indoor") & F.col("right_occupancy_state").startswith("indoor")
    away = ("probable_away", "confirmed_away")
    stratum = (
        F.when((F.col("left_occupancy_state") == "unknown") | (F.col("right_occupancy_state") == "unknown"), "unknown")
        .when(F.col("left_occupancy_state").isin(*away) | F.col("right_occupancy_state").isin(*away), "away")
        .when((F.col("left_behaviour_state") == "main_sleep") | (F.col("right_behaviour_state") == "main_sleep"), "sleep")
        .otherwise("awake")
    )
    m = m.withColumns(
        {
            "raw_copresent": F.coalesce(F.col("left_raw_room") == F.col("right_raw_room"), F.lit(False)),
            "corrected_copresent": F.coalesce(indoor & (F.col("left_corrected_room") == F.col("right_corrected_room")), F.lit(False)),
            "stratum": stratum,
        }
    )
    raw, cor = F.col("raw_copresent"), F.col("corrected_copresent")
    n = lambda c: F.sum(c.cast("bigint"))
    aggs = [
        F.count("*").alias("overlap_windows"), n(raw).alias("raw_copresent_windows"), n(cor).alias("corrected_copresent_windows"),
        n(~raw & cor).alias("added_copresent_windows"), n(raw & ~cor).alias("removed_copresent_windows"),
    ]
    hours = window_s / 3600.0
    report = (
        m.groupingSets([["pair_id", "stratum"], ["pair_id"]], "pair_id", "stratum")
        .agg(*aggs, F.grouping("stratum").alias("_all"))
        .withColumn("stratum", F.when(F.col("_all") == 1, "all").otherwise(F.col("stratum")))
        .drop("_all")
        .withColumns({"raw_copresent_hours": F.col("raw_copresent_windows") * hours, "corrected_copresent_hours": F.col("corrected_copresent_windows") * hours})
    )
    return m, report


def classify_state(left_home: str, left_room: str, right_home: str, right_room: str):
    names = list(STATES)
    lh, rh = F.coalesce(F.col(left_home), F.lit(False)), F.coalesce(F.col(right_home), F.lit(False))
    return (
        F.when(lh & rh & (F.col(left_room) == F.col(right_room)), names[0])
        .when(lh & rh, names[1])
        .when(lh, names[2])
        .when(rh, names[3])
        .otherwise(names[4])
    )


def copresence_state(evidence: DataFrame, pairs: DataFrame, window_s: int, columns: Sequence[str] = ("room", "in_home", "confidence")) -> DataFrame:
    """Both people on their common grid with the five-way state. ``evidence`` has
    (session_id, w, room, in_home, confidence); windows without it count as away."""
    evidence = durable(evidence)  # span, left and right side
    grid = grid_common(evidence, pairs, window_s)

    def side(name: str) -> DataFrame:
        return evidence.select(F.col("session_id").alias(f"{name}_session"), "w", *[F.col(c).alias(f"{name}_{c}") for c in columns])

    out = grid.join(side("left"), ["left_session", "w"], "left").join(side("right"), ["right_session", "w"], "left")
    state = classify_state("left_in_home", "left_room", "right_in_home", "right_room")
    labels = F.create_map(*[x for k, v in STATES.items() for x in (F.lit(k), F.lit(v))])
    return out.na.fill(False, ["left_in_home", "right_in_home"]).withColumn("state", state).withColumn("label", labels[F.col("state")]).withColumn(
        "minimum_confidence", F.least("left_confidence", "right_confidence")
    )


def copresence_summary(timeline: DataFrame, window_s: int, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Windows, hours, share per state; states that never occur report 0."""
    per = timeline.groupBy(*keys, "state").agg(F.count("*").alias("n"))
    total = per.groupBy(*keys).agg(F.sum("n").alias("total_windows"))
    dim = total.select(*keys, "total_windows", F.explode(F.array(*[F.lit(s) for s in STATES])).alias("state"))
    hours = window_s / 3600.0
    return dim.join(per, [*keys, "state"], "left").select(
        *keys, "state", F.coalesce("n", F.lit(0)).alias("windows"), (F.coalesce("n", F.lit(0)) * hours).alias("hours"),
        (F.coalesce("n", F.lit(0)) / F.col("total_windows")).alias("share"), "total_windows", (F.col("total_windows") * hours).alias("total_hours"),
    )


def copresence_by_day(timeline: DataFrame, window_s: int) -> DataFrame:
    """Hours per day × state."""
    out = timeline.withColumn("day", F.to_date("w")).groupBy("pair_id", "day").pivot("state", list(STATES)).count().na.fill(0)
    return out.select("pair_id", "day", *[(F.col(s) * (window_s / 3600.0)).alias(s) for s in STATES])


def copresence_by_hour(timeline: DataFrame) -> DataFrame:
    """Share of each state per hour of day."""
    out = timeline.withColumn("hour", F.hour("w")).groupBy("pair_id", "hour").pivot("state", list(STATES)).count().na.fill(0)
    total = sum((F.col(s) for s in STATES), F.lit(0))
    return out.select("pair_id", "hour", *[(F.col(s) / total).alias(s) for s in STATES])


def same_room_by_location(timeline: DataFrame, window_s: int) -> DataFrame:
    """Windows, hours, share per room while together."""
    per = timeline.filter(F.col("state") == list(STATES)[0]).groupBy("pair_id", F.col("left_room").alias("room")).agg(F.count("*").alias("windows"))
    share = F.col("windows") / F.sum("windows").over(Window.partitionBy("pair_id"))
    return per.withColumns({"hours": F.col("windows") * (window_s / 3600.0), "share": share})


def label_grid(intervals: DataFrame, pairs: DataFrame, step_s: int = 10, default: str = "Unknown") -> DataFrame:
    """Both people's label on a fine common grid, last interval wins, closed
    bounds. Grid points come from intervals that are first cut to the pair's
    common span; one row per (pair, time) leaves the aggregation."""
    from ..functions.timefn import ceil_ts, floor_ts

    span = intervals.groupBy("session_id").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    l = span.select(F.col("session_id").alias("left_session"), F.col("a").alias("la"), F.col("b").alias("lb"))
    r = span.select(F.col("session_id").alias("right_session"), F.col("a").alias("ra"), F.col("b").alias("rb"))
    common = pairs.join(l, "left_session").join(r, "right_session").select(
        "pair_id", "left_session", "right_session", floor_ts(F.greatest("la", "ra"), step_s).alias("a"), ceil_ts(F.least("lb", "rb"), step_s).alias("b")
    ).filter("a <= b")
    step = F.expr(f"make_dt_interval(0, 0, 0, {int(step_s)})")
    grid = common.select("pair_id", F.explode(F.sequence("a", "b", step)).alias("t"))
    member = common.select("pair_id", "a", "b", F.inline(F.array(
        F.struct(F.col("left_session").alias("session_id"), F.lit("left").alias("side")),
        F.struct(F.col("right_session").alias("session_id"), F.lit("right").alias("side")),
    )))
    cut = intervals.join(member, "session_id").select(
        "pair_id", "side", F.struct("seq", "label").alias("_l"), F.greatest("start", "a").alias("s"), F.least("end", "b").alias("e")
    )
    points = cut.select("pair_id", "side", "_l", F.explode(bins(ceil_ts("s", step_s), F.col("e"), step_s, closed=True)).alias("t"))
    both = points.groupBy("pair_id", "t").agg(
        F.max(F.when(F.col("side") == "left", F.col("_l"))).alias("_left"), F.max(F.when(F.col("side") == "right", F.col("_l"))).alias("_right")
    )
    return grid.join(both, ["pair_id", "t"], "left").select(
        "pair_id", "t", F.coalesce(F.col("_left.label"), F.lit(default)).alias("left_label"), F.coalesce(F.col("_right.label"), F.lit(default)).alias("right_label")
    )


def _hour_parts(rows: DataFrame, named: Sequence[str], step_s: int) -> DataFrame:
    """Intervals as ranges of grid numbers (closed bounds), cut at full hours."""
    us, per = step_s * 1_000_000, 3600 // step_s
    a, b = F.ceil(F.unix_micros("start") / us), F.floor(F.unix_micros("end") / us) + 1
    cut = rows.select(*named, "seq", "label", a.alias("_a"), b.alias("_b")).filter("_a < _b")
    hours = F.sequence(F.floor(F.col("_a") / per), F.floor((F.col("_b") - 1) / per))
    cut = cut.withColumn("h", F.explode(hours))
    return cut.select(*named, "h", F.greatest("_a", F.col("h") * per).alias("a"), F.least("_b", (F.col("h") + 1) * per).alias("b"), "seq", "label")


def _hour_start(h: str) -> Column:
    return F.timestamp_micros(F.col(h) * 3_600_000_000)


def label_segments(intervals: DataFrame, pairs: DataFrame, step_s: int = 10, default: str = "Unknown") -> tuple[DataFrame, DataFrame]:
    """What :func:`label_grid` says, without its rows: (pair_id, h, n, left_label,
    right_label) for the ``n`` grid points of each stretch of hour ``h`` that either
    person's intervals cover, and (pair_id, h, points) for all hours of the common span."""
    us, per = step_s * 1_000_000, 3600 // step_s
    span = intervals.groupBy("session_id").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    l = span.select(F.col("session_id").alias("left_session"), F.col("a").alias("la"), F.col("b").alias("lb"))
    r = span.select(F.col("session_id").alias("right_session"), F.col("a").alias("ra"), F.col("b").alias("rb"))
    lo, hi = F.floor(F.unix_micros(F.greatest("la", "ra")) / us), F.ceil(F.unix_micros(F.least("lb", "rb")) / us)
    common = pairs.join(l, "left_session").join(r, "right_session").select("pair_id", "left_session", "right_session", lo.alias("lo"), hi.alias("hi")).filter("lo <= hi")
    hours = common.withColumn("h", F.explode(F.sequence(F.floor(F.col("lo") / per), F.floor(F.col("hi") / per))))
    hours = hours.select("pair_id", "h", (F.least("hi", (F.col("h") + 1) * per - 1) - F.greatest("lo", F.col("h") * per) + 1).alias("points"))
    member = common.select("pair_id", "lo", "hi", F.inline(F.array(
        F.struct(F.col("left_session").alias("session_id"), F.lit("left").alias("side")),
        F.struct(F.col("right_session").alias("session_id"), F.lit("right").alias("side")),
    )))
    inside = intervals.join(member, "session_id").select(
        "pair_id", "side", "seq", "label", F.greatest("start", F.timestamp_micros(F.col("lo") * us)).alias("start"), F.least("end", F.timestamp_micros(F.col("hi") * us)).alias("end")
    )
    cut = segments(_hour_parts(inside, ["pair_id", "side"], step_s), ["pair_id", "side", "h"])
    said = {side: F.max(F.when(F.col("side") == side, F.struct("t", F.col("label").alias("v")))).alias(side) for side in ("left", "right")}
    events = cut.groupBy("pair_id", "h", "t").agg(*said.values())
    order = Window.partitionBy("pair_id", "h").orderBy("t")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    lasting = events.withColumns({side: F.last(side, ignorenulls=True).over(upto) for side in said} | {"n": F.lead("t").over(order) - F.col("t")})
    out = lasting.filter("n > 0").select("pair_id", "h", "n", *[F.coalesce(F.col(f"{side}.v"), F.lit(default)).alias(f"{side}_label") for side in said])
    return out, hours


def _together(excluded: Sequence[str]):
    return (F.col("left_label") == F.col("right_label")) & ~F.col("left_label").isin(*excluded)


def copresence_heatmap(intervals: DataFrame, pairs: DataFrame, excluded: Sequence[str] = ("Out", "Unknown"), step_s: int = 10) -> DataFrame:
    """Day × hour share of time together."""
    parts, hours = label_segments(intervals, pairs, step_s)
    met = parts.filter(_together(excluded)).groupBy("pair_id", "h").agg(F.sum("n").alias("_n"))
    per = hours.join(met, ["pair_id", "h"], "left").withColumn("c", F.coalesce("_n", F.lit(0)) / F.col("points"))
    per = per.select("pair_id", F.to_date(_hour_start("h")).alias("day"), F.hour(_hour_start("h")).alias("hour"), "c")
    return per.groupBy("pair_id", "day").pivot("hour", list(range(24))).agg(F.first("c")).withColumnsRenamed({str(h): f"h{h:02d}" for h in range(24)})


def copresence_daily_ratio(intervals: DataFrame, pairs: DataFrame, excluded: Sequence[str] = ("Out", "Unknown"), min_hours: int = 20, step_s: int = 10) -> DataFrame:
    """Share of valid time together on days that cover enough hours."""
    parts, _ = label_segments(intervals, pairs, step_s)
    valid = parts.filter((F.col("left_label") != "Unknown") & (F.col("right_label") != "Unknown"))
    met = F.sum(F.when(_together(excluded), F.col("n")).otherwise(0))
    return (
        valid.withColumn("day", F.to_date(_hour_start("h")))
        .groupBy("pair_id", "day")
        .agg(F.count_distinct("h").alias("hours"), (met / F.sum("n")).alias("ratio"))
        .filter(F.col("hours") >= min_hours)
    )


def hourly_room(intervals: DataFrame, step_s: int = 10, default: str = "Unknown") -> DataFrame:
    """Modal label per hour on the fine grid (ties to the smallest label)."""
    from .topk import mode_label

    cut = segments(_hour_parts(intervals, ["session_id"], step_s), ["session_id", "h"]).filter("label is not null")
    per = cut.groupBy("session_id", _hour_start("h").alias("w"), "label").agg(F.sum(F.col("until") - F.col("t")).alias("n"))
    # grid points no interval covers are 'Unknown'
    known = per.groupBy("session_id", "w").agg(F.sum("n").alias("k"))
    span = known.groupBy("session_id").agg(F.min("w").alias("a"), F.max("w").alias("b"))
    hours = span.select("session_id", F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("w"))
    missing = hours.join(known, ["session_id", "w"], "left").select(
        "session_id", "w", F.lit(default).alias("label"), (F.lit(3600 // step_s) - F.coalesce("k", F.lit(0))).alias("n")
    )
    return mode_label(per.unionByName(missing.filter("n > 0")), ["session_id", "w"], "label", "n").select("session_id", "w", "label")


def left_right_compare(timeline: DataFrame, high: float = 0.70, low: float = 0.40) -> DataFrame:
    """Agreement and correlation of two devices per pair. ``timeline`` has
    left_/right_ beacon, room, steps, motion, confidence."""
    lc, rc = F.col("left_confidence"), F.col("right_confidence")
    both = F.col("left_room").isNotNull() & F.col("right_room").isNotNull()
    same = lambda c: F.coalesce(F.col(f"left_{c}") == F.col(f"right_{c}"), F.lit(False)).cast("int")
    return timeline.groupBy("pair_id").agg(
        F.count("*").alias("common_windows"), F.min("w").alias("common_start"), F.max("w").alias("common_end"),
        F.avg(same("beacon")).alias("same_beacon_fraction"), F.avg(F.when(both, same("room"))).alias("same_room_fraction"),
        F.corr("left_steps", "right_steps").alias("step_correlation"), F.corr("left_motion", "right_motion").alias("motion_correlation"),
        F.corr("left_confidence", "right_confidence").alias("confidence_correlation"),
        F.count(F.when((lc >= high) & (rc < low), 1)).alias("left_high_right_low"), F.count(F.when((rc >= high) & (lc < low), 1)).alias("right_high_left_low"),
    )


def role_stability(timeline: DataFrame, window_s: int, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """In-home share, confidence, dominance, gap and room changes (missing is a
    state) per role."""
    from .runs import transition_count_missing

    stats = timeline.groupBy(*keys).agg(
        F.count("*").alias("windows"), F.avg(F.col("in_home").cast("int")).alias("in_home_fraction"), F.avg("confidence").alias("mean_confidence"),
        F.percentile("confidence", F.lit(0.5)).alias("median_confidence"), F.avg("dominance").alias("mean_dominance"), F.avg("gap_db").alias("mean_gap"),
    )
    days = F.greatest(F.col("windows") * window_s / 86_400.0, F.lit(1.0))
    return stats.join(transition_count_missing(timeline, "room", keys), list(keys)).withColumns(
        {"unmapped_fraction": 1 - F.col("in_home_fraction"), "transitions_per_day": F.col("transitions") / days}
    )


def stack_methods(tables: dict[str, DataFrame]) -> DataFrame:
    """Union of per-method tables with a ``method`` column."""
    out = None
    for name, t in tables.items():
        t = t.withColumn("method", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def method_state_hours(summaries: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Hours by method × state."""
    return summaries.groupBy(*keys, "method").pivot("state", list(STATES)).agg(F.sum("hours"))


def method_disagreement(wide: DataFrame, a: str, b: str, c: str, unmapped: str = "Unmapped") -> DataFrame:
    """``all agree`` / ``all differ`` / which pair differs, per row."""
    x, y, z = (F.coalesce(F.col(m), F.lit(unmapped)) for m in (a, b, c))
    label = (
        F.when((x == y) & (x == z), "all agree")
        .when((x != y) & (x != z) & (y != z), "all differ")
        .when(x != y, f"{a} vs {b} differ")
        .when(x != z, f"{a} vs {c} differ")
        .otherwise(f"{b} vs {c} differ")
    )
    return wide.withColumn("disagreement", label)


def disagreement_summary(wide: DataFrame, methods: Sequence[str], window_s: int, keys: Sequence[str] = ("session_id",), unmapped: str = "Unmapped") -> DataFrame:
    """Agree / differ hours and shares for each method pair."""
    hours = window_s / 3600.0
    pairs = [(a, b) for i, a in enumerate(methods) for b in methods[i + 1 :]]
    eq = {(a, b): F.coalesce(F.col(a), F.lit(unmapped)) == F.coalesce(F.col(b), F.lit(unmapped)) for a, b in pairs}
    flat = wide.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(e.cast("bigint")).alias(f"{a}|{b}") for (a, b), e in eq.items()])
    rows = F.array(*[F.struct(F.lit(f"{a} vs {b}").alias("method_pair"), F.col(f"`{a}|{b}`").alias("agree")) for a, b in pairs])
    out = flat.select(*keys, "n", F.inline(rows))
    return out.select(
        *keys, "method_pair", (F.col("agree") * hours).alias("agree_hours"), ((F.col("n") - F.col("agree")) * hours).alias("differ_hours"),
        (F.col("agree") / F.col("n")).alias("agree_fraction"), ((F.col("n") - F.col("agree")) / F.col("n")).alias("differ_fraction"), (F.col("n") * hours).alias("total_hours"),
    )


def resample_mode_diag(fine: DataFrame, coarse: DataFrame, window_s: int, target: str, unmapped: str = "Unmapped") -> DataFrame:
    """Coarse windows where the modal fine room is unmapped but the coarse room
    is ``target``."""
    from ..functions.timefn import floor_ts
    from .topk import mode_label

    binned = fine.withColumn("w", floor_ts("w", window_s))
    mode = mode_label(binned, ["session_id", "w"], "room").select("session_id", "w", F.col("room").alias("fine_room"))
    agg = binned.groupBy("session_id", "w").agg(F.sum("samples").alias("fine_samples"))
    out = agg.join(mode, ["session_id", "w"], "left").na.fill({"fine_room": unmapped})
    return out.join(coarse, ["session_id", "w"]).filter((F.col("fine_room") == unmapped) & (F.col("room") == target))
