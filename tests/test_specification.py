"""Small hand-made inputs with known answers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from roomtrail.operators import calibration, cluster, copresence, ordered, pressure, quantiles, runs, sleep, states, topk, windows
from roomtrail.params import InferenceParams
from roomtrail.plans.inference import run_inference

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
M5 = dt.timedelta(minutes=5)
P = InferenceParams()


def at(i, step=M5):
    return T0 + i * step


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(spark, xs, session=1):
    return frame(spark, [(session, at(i), float(x)) for i, x in enumerate(xs)], "session_id bigint, w timestamp, x double")


# -- clustering ------------------------------------------------------------------
def test_two_level_movement(spark):
    rows = [(1, at(i), 0.004 if i < 60 else 0.08, "acc") for i in range(120)]
    out, diag = cluster.classify_movement(frame(spark, rows, "session_id bigint, w timestamp, movement_value double, movement_source string"), P)
    got = out.orderBy("w").collect()
    assert {r.movement_k for r in got} == {2}
    assert all(r.low_motion for r in got[:60]) and not any(r.low_motion for r in got[60:])
    assert diag.filter("selected").count() == 1


def test_smaller_k_wins_near_best(spark):
    df = values(spark, [0.0] * 50 + [1.0] * 50)
    models, _ = cluster.choose_ordered_clustering(df, ["session_id"], "x", (2, 3), 10, 0.05, 0.25, 0.02)
    assert models.first().k == 2


def episodes(spark, minutes):
    return frame(spark, [(1, i, float(m)) for i, m in enumerate(minutes)], "session_id bigint, episode_id int, duration_minutes double")


def test_sleep_four_episodes(spark):
    out, _ = states.main_sleep(episodes(spark, [75, 90, 420, 480]), P)
    got = out.collect()
    assert all(r.sleep_resolved for r in got) and sum(r.main_sleep for r in got) == 2


def test_sleep_rejects_singleton_class(spark):
    out, diag = states.main_sleep(episodes(spark, [75, 80, 90, 100, 1000]), P)
    assert not any(r.sleep_resolved or r.main_sleep for r in out.collect())
    assert diag.filter("accepted").count() == 0


def test_borderline_tier(spark):
    df = values(spark, [95, 350, 190, 225, 330, 305, 165]).withColumn("x", F.log("x"))
    models, diag = cluster.choose_ordered_clustering(df, ["session_id"], "x", (2,), 2, 0.0, 0.50, 0.0, 0.45, 2.0)
    assert models.first().separation_tier == "borderline" and diag.first().accepted


def brute_sse(xs, k):
    xs = sorted(xs)

    def sse(part):
        m = sum(part) / len(part)
        return sum((v - m) ** 2 for v in part)

    from itertools import combinations

    return min(sum(sse(xs[a:b]) for a, b in zip((0, *c), (*c, len(xs)))) for c in combinations(range(1, len(xs)), k - 1))


@pytest.mark.parametrize("k", [2, 3, 4])
def test_kmeans_is_optimal(spark, k):
    rng = random.Random(7)
    xs = [rng.gauss(c, 1.0) for c in (0, 4, 9, 15) for _ in range(6)]
    df = values(spark, xs)
    model = cluster.kmeans1d_ordered(cluster.histogram(df, ["session_id"], "x"), ["session_id"], [k]).first()
    total = sum(min((x - c) ** 2 for c in model.centers) for x in xs)
    assert total == pytest.approx(brute_sse(xs, k), rel=1e-9)


def test_many_distinct_values(spark):
    rng = random.Random(3)
    xs = [rng.gauss(c, 1.0) for c in (0, 6, 12) for _ in range(60)]
    hist = cluster.histogram(values(spark, xs), ["session_id"], "x")
    for r in cluster.kmeans1d_ordered(hist, ["session_id"], [2, 3]).collect():
        assert r.converged and sum(min((x - c) ** 2 for c in r.centers) for x in xs) == pytest.approx(brute_sse(xs, r.k), rel=1e-9)


def test_silhouette_matches_brute_force(spark):
    rng = random.Random(11)
    xs = [round(rng.gauss(c, 1.5), 2) for c in (0, 5, 9) for _ in range(9)] + [40.0]
    df = values(spark, xs)
    hist = cluster.histogram(df, ["session_id"], "x")
    model = cluster.kmeans1d_ordered(hist, ["session_id"], [3])
    got = cluster.silhouette1d(hist, model, ["session_id"]).first().silhouette
    uppers = model.first().uppers
    lab = [sum(u < x for u in uppers) for x in xs]
    scores = []
    for i, x in enumerate(xs):
        own = [abs(x - y) for j, y in enumerate(xs) if lab[j] == lab[i] and j != i]
        if not own:
            scores.append(0.0)
            continue
        a = sum(own) / len(own)
        b = min(sum(abs(x - y) for j, y in enumerate(xs) if lab[j] == c) / lab.count(c) for c in set(lab) - {lab[i]})
        scores.append((b - a) / max(a, b))
    assert got == pytest.approx(sum(scores) / len(scores), rel=1e-9)


def test_bootstrap_interval_covers_median(spark):
    df = values(spark, range(1, 202))
    row = cluster.bootstrap_median_ci(df, ["session_id"], "x").first()
    assert 80 < row.ci_low < 101 < row.ci_high < 122


# -- inputs ------------------------------------------------------------------------
def test_low_coverage_is_missing(spark):
    w = frame(spark, [(1, at(i), "A", m, c) for i, (m, c) in enumerate([(-60.0, 10), (-61.0, 1), (-62.0, 10)])], "session_id bigint, w timestamp, beacon string, rssi_mean double, rssi_cnt bigint")
    mid = windows.rssi_quality_filter(w).orderBy("w").collect()[1]
    assert mid.rssi_mean is None and mid.coverage < 1


def test_tie_goes_to_first_beacon(spark):
    w = frame(spark, [(1, at(0), "B", -60.0, 1), (1, at(0), "A", -60.0, 1)], "session_id bigint, w timestamp, beacon string, rssi_mean double, rssi_cnt bigint")
    assert topk.strongest_beacon(w).first().strongest_beacon == "A"


def steps(spark, pairs):
    return frame(spark, [(1, T0 + dt.timedelta(minutes=m), float(c)) for m, c in pairs], "session_id bigint, ts timestamp, cnt double")


def test_counter_reset(spark):
    inc = windows.step_increments(steps(spark, [(0, 100), (1, 110), (2, 3), (3, 8)]))
    assert inc.agg(F.sum("increment")).first()[0] == 15.0


@pytest.mark.parametrize("pairs,filled,total", [([(0, 100), (31, 100)], True, 0.0), ([(0, 100), (31, 110)], False, 10.0), ([(0, 100), (40, 100)], False, 0.0)])
def test_plateaus(spark, pairs, filled, total):
    got = windows.step_zero_plateau(windows.step_increments(steps(spark, pairs))).collect()
    seen = {r.w.replace(tzinfo=dt.timezone.utc) for r in got}
    assert (at(1) in seen) is filled
    assert sum(r.step_increment for r in got) == total
    if filled:
        assert {at(i) for i in range(7)} <= seen


def test_chunks_do_not_change_ordered_results(spark):
    rng = random.Random(5)
    rows = [(s, T0 + dt.timedelta(seconds=rng.randrange(200_000)), i, float(rng.randrange(9)), rng.random() < 0.3) for s in (1, 2) for i in range(150)]
    df = frame(spark, rows, "session_id bigint, ts timestamp, i bigint, v double, f boolean")

    def run(chunk):
        o = ordered.Ordered(df, ties=["i"], chunk_seconds=chunk).apply(
            lag={"p": "v"}, lead={"n": "v"}, running_sum={"s": "v"}, total={"t": "v"}, last_known={"lk": ("v", "f")}, next_known={"nk": ("v", "f")}
        )
        return sorted(map(tuple, o.done().select("i", "session_id", "p", "n", "s", "t", "lk", "nk").collect()))

    assert run(3600) == run(10**9)


def test_exact_quantiles_of_skewed_values(spark):
    rng = random.Random(9)
    xs = [1.0] * 4000 + [rng.random() * 100 for _ in range(3001)]
    df = values(spark, xs).unionByName(values(spark, [5.0, 6.0], 2))
    got = {r.session_id: r for r in quantiles.exact_quantiles(df, ["session_id"], "x", {"a": 0.5, "b": 0.9}, accuracy=100).collect()}
    want = {r.session_id: r for r in df.groupBy("session_id").agg(F.percentile("x", F.lit(0.5)).alias("a"), F.percentile("x", F.lit(0.9)).alias("b")).collect()}
    for s in (1, 2):
        assert got[s].a == pytest.approx(want[s].a) and got[s].b == pytest.approx(want[s].b)


def test_rolling_median_over_bucket_edges(spark):
    rng = random.Random(2)
    df = frame(spark, [(1, T0 + dt.timedelta(seconds=i), rng.random()) for i in range(120)], "session_id bigint, ts timestamp, v double")
    small = runs.rolling_median(df, "v", "m", 7, rows_per_bucket=10)
    big = runs.rolling_median(df, "v", "m", 7)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, big.collect()))


def test_smoothing_equals_left_to_right_walk(spark):
    rng = random.Random(4)
    seq = [rng.choice(["a", "b", "b", None]) for _ in range(300)]
    vals, i = list(seq), 0
    while i < len(vals):
        if vals[i] is None:
            i += 1
            continue
        j = i
        while j + 1 < len(vals) and vals[j + 1] == vals[i]:
            j += 1
        if j - i + 1 <= 2 and i > 0 and j + 1 < len(vals) and vals[i - 1] is not None and vals[i - 1] == vals[j + 1] != vals[i]:
            vals[i : j + 1] = [vals[i - 1]] * (j - i + 1)
        i = j + 1
    df = frame(spark, [(1, at(i), v) for i, v in enumerate(seq)], "session_id bigint, w timestamp, v string")
    assert [r.o for r in runs.smooth_short_runs(df, "v", "o").orderBy("w").collect()] == vals


# -- states ----------------------------------------------------------------------
def test_bedroom_needs_two_nights(spark):
    rows = [(1, i, dt.datetime(2026, 1, 1 + i, 22, tzinfo=dt.timezone.utc), True, True, "B", 50, 40) for i in range(2)]
    ep = frame(spark, rows, "session_id bigint, episode_id int, start timestamp, main_sleep boolean, room_supported boolean, dominant_beacon string, observed_windows bigint, dominant_count bigint")
    sess = frame(spark, [(1, "UTC")], "session_id bigint, timezone string")
    assert sleep.infer_bedroom(ep, sess).first().bedroom_beacons == "B"
    assert sleep.infer_bedroom(ep.filter("episode_id = 0"), sess).first().bedroom_source == "unresolved"


def corrected(spark, beacons, eligible=True, dominant="B"):
    rooms = {"B": "Bedroom", "X": "Bathroom"}
    t = frame(spark, [(1, at(i), b, rooms.get(b), b is not None) for i, b in enumerate(beacons)], "session_id bigint, w timestamp, base_beacon string, base_room string, rssi_observed boolean")
    e = frame(spark, [(1, 1, at(0), at(len(beacons)), True, eligible, dominant, rooms[dominant])], "session_id bigint, episode_id int, start timestamp, end timestamp, main_sleep boolean, room_correction_eligible boolean, dominant_beacon string, dominant_room string")
    return sleep.sleep_correction(t, e, 300, P).orderBy("w").collect()


def test_two_sided_gap_is_filled(spark):
    got = corrected(spark, ["B"] * 4 + [None] * 2 + ["B"] * 6)
    assert all(r.sleep_gap_filled and r.corrected_room == "Bedroom" for r in got[4:6])


def test_one_sided_gap_stays_missing(spark):
    assert all(r.corrected_beacon is None for r in corrected(spark, [None] * 2 + ["B"] * 6)[:2])


def test_ineligible_episode_keeps_rooms(spark):
    got = corrected(spark, ["B", "B"] + ["X"] * 6, eligible=False, dominant="X")
    assert [r.corrected_room for r in got] == [r.base_room for r in got] and all(r.main_sleep for r in got)


def test_away_ignores_sleep(spark):
    gone = {i + k for i, n in ((12, 1), (14, 1), (16, 1), (18, 4), (23, 4), (28, 4)) for k in range(n)}
    t = frame(spark, [(1, at(i), i not in gone, True, i < 12) for i in range(36)], "session_id bigint, w timestamp, rssi_observed boolean, wearable_online boolean, main_sleep boolean")
    runs_, _ = states.away_runs(t, InferenceParams(away_silhouette_min=0.1))
    got = runs_.collect()
    assert len(got) == 6 and all(r.start.replace(tzinfo=dt.timezone.utc) >= at(12) for r in got)


# -- votes ---------------------------------------------------------------------
def vote(spark, beacons, low, rssi=None):
    t = frame(spark, [(1, at(i), b, b is not None, lo) for i, (b, lo) in enumerate(zip(beacons, low))], "session_id bigint, w timestamp, beacon string, observed boolean, low_motion boolean")
    t = runs.observed_segments(t, "observed", 300)
    cells = frame(spark, rssi or [(1, at(i), b, -60.0) for i, b in enumerate(beacons) if b], "session_id bigint, w timestamp, beacon string, rssi_mean double")
    return runs.centred_vote(t, cells, 300).orderBy("w").collect()


def test_vote_majority_and_motion(spark):
    got = vote(spark, ["A", "A", "B", "A", "A", "A"], [True] * 6)
    assert got[2].corrected_beacon == "A"
    got = vote(spark, ["A", "A", "B", "A", "A", "A"], [True, True, False, True, True, True])
    assert got[2].corrected_beacon == "B" and got[2].correction_reason == "high_motion_keep_raw"


def test_vote_tie_by_signal_and_missing(spark):
    cells = [(1, at(i), b, v) for i in range(4) for b, v in (("A", -70.0), ("B", -60.0))]
    got = vote(spark, ["A", "A", "B", "B"], [True] * 4, cells)
    assert {r.corrected_beacon for r in got} == {"B"}
    got = vote(spark, ["A", None, "B", "B"], [True] * 4)
    assert got[1].corrected_beacon is None and got[0].corrected_beacon == "A"


def test_bridged_bout(spark):
    high = {10, 11, 12}
    t = frame(spark, [(1, at(i), i not in high) for i in range(50)], "session_id bigint, w timestamp, low_motion boolean")
    got = runs.bridged_bouts(t, "low_motion", 300).collect()
    assert len(got) == 1 and got[0].duration_minutes == 250


# -- whole chain -----------------------------------------------------------------
def infer(spark, cells, moves, n=120):
    grid = frame(spark, [(1, at(i)) for i in range(n)], "session_id bigint, w timestamp")
    rssi = frame(spark, cells, "session_id bigint, w timestamp, beacon string, rssi_mean double, rssi_cnt bigint")
    movement = frame(spark, [(1, at(i), m, "acc") for i, m in enumerate(moves)], "session_id bigint, w timestamp, movement_value double, movement_source string")
    online = grid.withColumn("wearable_online", F.lit(True))
    beacons = frame(spark, [("A", "Living"), ("B", "Bedroom")], "beacon string, room string")
    sess = frame(spark, [(1, "UTC")], "session_id bigint, timezone string")
    return run_inference(grid, rssi, movement, online, beacons, sess).timeline.orderBy("w").collect()


def test_look_back_stops_at_gap(spark):
    cells = [(1, at(i), b, v, 1) for i in range(120) if i != 90 for b, v in (("A", -60.0 if i < 91 else -90.0), ("B", -80.0 if i < 91 else -50.0))]
    assert infer(spark, cells, [0.004] * 100 + [0.08] * 20)[91].corrected_beacon == "B"


def test_awake_missing_is_never_filled(spark):
    cells = [(1, at(i), b, v, 1) for i in range(120) if i != 80 for b, v in (("A", -60.0), ("B", -80.0))]
    got = infer(spark, cells, [0.004] * 60 + [0.08] * 60)
    assert got[80].corrected_room is None
    assert got[-1].adaptive_window_minutes == 5 and got[-1].corrected_beacon == got[-1].raw_beacon


def test_missing_rooms_are_not_together(spark):
    rows = [(s, at(i), r, r, o, "awake") for s in (1, 2) for i, (r, o) in enumerate([(None, "unknown"), ("Living", "indoor_observed")])]
    t = frame(spark, rows, "session_id bigint, w timestamp, raw_room string, corrected_room string, occupancy_state string, behaviour_state string")
    pairs = frame(spark, [(1, 1, 2)], "pair_id bigint, left_session bigint, right_session bigint")
    merged, report = copresence.copresence_pair(t, pairs)
    got = merged.orderBy("w").collect()
    assert not got[0].raw_copresent and got[1].corrected_copresent
    assert report.count() == 3


# -- pressure ------------------------------------------------------------------
def environment(spark, offsets):
    import math

    rows = [(1, at(i), s, 1000 + math.sin(4 * math.pi * i / 199) + o) for i in range(200) for s, o in offsets.items()]
    return frame(spark, rows, "session_id bigint, w timestamp, sensor string, hpa double")


def test_same_floor_offsets_are_rejected(spark):
    groups, audit = pressure.auto_floor_groups(environment(spark, {"A": -0.12, "B": -0.11, "C": 0.11, "D": 0.12}))
    row = audit.first()
    assert groups.count() == 0 and row.floor_k == 1 and "floor_scale_separation" in row.reason


def test_storey_offsets_are_accepted(spark):
    groups, audit = pressure.auto_floor_groups(environment(spark, {"A": -0.20, "B": -0.18, "C": 0.18, "D": 0.20}))
    assert groups.select("floor").distinct().count() == 2 and audit.first().min_separation >= 0.30


def test_manual_groups_with_missing_window(spark):
    n = 120
    grid = frame(spark, [(1, at(i)) for i in range(n)], "session_id bigint, w timestamp")
    cells = frame(spark, [(1, at(i), b, v, 1) for i in range(n) if i != 10 for b, v in (("A", -60.0), ("B", -70.0), ("C", -80.0), ("D", -85.0))], "session_id bigint, w timestamp, beacon string, rssi_mean double, rssi_cnt bigint")
    env = frame(spark, [(1, at(i), s, v) for i in range(n) if i != 10 for s, v in (("A", 1000.4), ("B", 1000.42), ("C", 1000.0), ("D", 1000.02))], "session_id bigint, w timestamp, sensor string, hpa double")
    wear = frame(spark, [(1, at(i), 1000.38) for i in range(n)], "session_id bigint, w timestamp, hpa double")
    groups = frame(spark, [(1, "A", "1F"), (1, "B", "1F"), (1, "C", "2F"), (1, "D", "2F")], "session_id bigint, sensor string, floor string")
    out, info, audit = pressure.pressure_constraint(grid, cells, env, wear, groups, grid.withColumn("moving", F.lit(True)))
    assert audit.first().pressure_enabled and info.filter("pressure_floor_trusted").count() > 0
    assert out.count() == cells.count() and out.filter("beacon in ('C', 'D') and rssi_mean is not null").count() == 0


def test_kfold_keeps_groups_whole(spark):
    rows = [(1, f"d{g}", i) for g, n in enumerate([30, 20, 10, 5, 4, 1]) for i in range(n)]
    out = calibration.group_kfold(frame(spark, rows, "session_id bigint, day string, i int"), "day", 3, ["session_id"])
    sizes = {r.fold: r.n for r in out.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert sizes == {1: 30, 2: 20, 3: 20}
    assert out.groupBy("day").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
