"""Operators against brute force on small inputs."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomtrail.operators import cluster, intervals, kmeans, metrics, sleep
from roomtrail.params import InferenceParams

T0 = dt.datetime(2024, 1, 1)


def minutes(m):
    return T0 + dt.timedelta(minutes=m)


def best_cut(x):
    x = np.sort(x)
    costs = [((x[:i] - x[:i].mean()) ** 2).sum() + ((x[i:] - x[i:].mean()) ** 2).sum() for i in range(1, len(x)) if x[i] > x[i - 1]]
    cuts = [x[i - 1] for i in range(1, len(x)) if x[i] > x[i - 1]]
    return cuts[int(np.argmin(np.round(costs, 9)))]


def test_two_clusters_are_optimal_at_any_size(spark):
    rng = np.random.default_rng(1)
    data = {0: rng.normal(0, 1, 3000), 1: np.concatenate([rng.normal(0, 1, 700), rng.normal(3, 2, 900)]), 2: np.array([1.0, 1.0, 2.0, 9.0]), 3: np.array([5.0, 5.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, own in data.items() for v in own], "session_id int, x double")
    got = {r.session_id: r for r in cluster.kmeans1d_ordered(cluster.histogram(rows, ["session_id"], "x"), ["session_id"], [2]).collect()}
    assert set(got) == {0, 1, 2}  # one distinct value has no two clusters
    for k in got:
        assert got[k].uppers[0] == best_cut(data[k]) and got[k].converged


def test_more_clusters_are_fixed_points(spark):
    rng = np.random.default_rng(2)
    data = {0: np.concatenate([rng.normal(m, 0.5, 700) for m in (0, 2, 5, 6)]), 1: rng.gamma(1, 1, 300), 2: np.array([1.0, 1.0, 2.0]), 3: np.array([1.0, 2.0, 4.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, own in data.items() for v in own], "session_id int, x double")
    got = cluster.kmeans1d_ordered(cluster.histogram(rows, ["session_id"], "x"), ["session_id"], [3, 4]).collect()
    assert {(r.session_id, r.k) for r in got} == {(0, 3), (0, 4), (1, 3), (1, 4), (3, 3)}  # a cluster needs a value of its own
    for r in got:
        x, c = data[r.session_id], np.array(r.centers)
        label = np.abs(x[:, None] - c[None, :]).argmin(axis=1)
        assert r.converged and len(c) == r.k
        assert np.allclose([x[label == i].mean() for i in range(r.k)], c, atol=1e-9)
        assert r.uppers == [x[label == i].max() for i in range(r.k - 1)]
        # the optimum over all values, not only over the places that were looked at
        values = np.sort(x) - x.mean()
        cuts = cluster.optimal_cuts(np.arange(1.0, len(x) + 1), np.cumsum(values), r.k)
        error = lambda at: sum(((v - v.mean()) ** 2).sum() for v in np.split(values, [i + 1 for i in at]))
        assert np.isclose(error(cuts), error([int((x <= u).sum()) - 1 for u in r.uppers]))


def test_optimal_cuts_equal_all_choices():
    rng = np.random.default_rng(4)
    for _ in range(20):
        x = np.sort(rng.normal(0, 1, 11))
        x -= x.mean()
        for k in (2, 3, 4):
            choices = {c: sum(((v - v.mean()) ** 2).sum() for v in np.split(x, [i + 1 for i in c])) for c in itertools.combinations(range(10), k - 1)}
            assert tuple(cluster.optimal_cuts(np.arange(1.0, 12), np.cumsum(x), k)) == min(choices, key=choices.get)


def test_windows_without_a_value_have_no_movement_state(spark):
    rows = [(0, minutes(5 * i), None if i % 4 == 0 else 0.004 if i % 2 else 0.08, "acc") for i in range(200)]
    out, _ = cluster.classify_movement(spark.createDataFrame(rows, "session_id int, w timestamp, movement_value double, movement_source string"), InferenceParams())
    got = {r.w: r for r in out.collect()}
    for _, w, value, _ in rows:
        assert got[w].movement_state == (None if value is None else 1 if value < 0.01 else 2)
        assert got[w].low_motion == (value == 0.004)


def test_vector_clusters_of_a_key_depend_on_it_alone(spark):
    rng = np.random.default_rng(3)
    spots = np.array([[0, 0], [6, 0], [0, 6]])
    rows = [(s, i, (spots[i % 3] * (1 + s) + rng.normal(0, 0.3, 2)).tolist()) for s in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "session_id int, i int, z array<double>")
    got = {r.session_id: r for r in kmeans.fit(df, ["session_id"], [3], 2, ["i"]).collect()}
    alone = kmeans.fit(df.filter("session_id = 1"), ["session_id"], [3], 2, ["i"]).first()
    assert np.allclose(got[1].centers, alone.centers) and all(r.converged for r in got.values())
    for s in range(3):
        want = sorted(np.mean([z for k, i, z in rows if k == s and i % 3 == c], axis=0).tolist() for c in range(3))
        assert np.allclose(sorted(got[s].centers), want)


def test_silhouette_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    z, label = rng.normal(0, 1, (40, 3)), rng.integers(0, 3, 40)
    label[0] = 7  # a cluster of one
    df = spark.createDataFrame([(0, int(c), v.tolist()) for c, v in zip(label, z)], "k int, c int, z array<double>")
    got = kmeans.silhouette(df, ["k"], "c", 3).first()
    d = ((z[:, None] - z[None, :]) ** 2).sum(axis=2)
    want = []
    for i in range(40):
        own = (label == label[i]) & (np.arange(40) != i)
        if not own.any():
            want.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, label == c].mean() for c in set(label.tolist()) - {label[i]})
        want.append((b - a) / max(a, b))
    assert abs(got.silhouette - np.mean(want)) < 1e-9 and got.smallest == 1


def test_points_take_the_last_interval(spark):
    rng = random.Random(5)
    spans = [(rng.randrange(2), s := rng.randrange(600), s + rng.choice([0, 1, 30, 200]), i, f"l{i % 5}") for i in range(80)]
    points = [(rng.randrange(3), i, rng.randrange(-10, 900)) for i in range(300)]
    iv = spark.createDataFrame([(k, minutes(a), minutes(b), q, label) for k, a, b, q, label in spans], "session_id int, start timestamp, end timestamp, seq int, label string")
    pt = spark.createDataFrame([(k, i, minutes(t)) for k, i, t in points], "session_id int, i int, ts timestamp")
    got = {r.i: r.label for r in intervals.join_point_interval(pt, iv, ["i"]).collect()}
    for k, i, t in points:
        held = [(q, label) for s, a, b, q, label in spans if s == k and a <= t < b]
        assert got[i] == (max(held)[1] if held else None)


def test_bedroom_ties_take_the_smallest_beacon(spark):
    rows = [("1", minutes(1440 * d + h), True, True, b, 5, 10) for d in range(3) for b, h in (("B", 10), ("A", 200))]
    schema = "session_id string, start timestamp, main_sleep boolean, room_supported boolean, dominant_beacon string, dominant_count int, observed_windows int"
    zones = spark.createDataFrame([("1", "UTC")], "session_id string, timezone string")
    got = sleep.infer_bedroom(spark.createDataFrame(rows, schema), zones, min_share=0.3).first()
    assert got.bedroom_beacons == "A"


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_threshold_coverage_with_and_without_keys(spark, keys):
    rows = [(0, "a", "a", 1.0), (0, "a", "b", 5.0), (0, None, "a", 1.0), (0, "b", "b", 9.0)]
    df = spark.createDataFrame(rows, "k int, reference string, prediction string, steps double")
    got = {r.step_threshold: r for r in metrics.metrics_by_threshold(df, "steps", [2, 6, 10], keys).collect()}
    assert [round(got[t].threshold_coverage, 6) for t in (2, 6, 10)] == [0.333333, 0.666667, 1.0]


def test_waiting_rows_come_in_event_time_order():
    """Late rows within the delay take their place; a wrapped counter is one reset."""
    import pandas as pd

    from roomtrail.streaming.operators import _step_update

    class State:
        exists = hasTimedOut = False
        get, mark = None, 0

        def getCurrentWatermarkMs(self):
            return self.mark

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutTimestamp(self, ms):
            assert ms > self.mark

        def remove(self):
            self.exists = False

    def frame(*rows):
        return pd.DataFrame([(1, pd.Timestamp(minutes(m)), i, c) for m, i, c in rows], columns=["session_id", "ts", "event_id", "cnt"])

    state = State()
    ms = lambda m: int(minutes(m).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    out = list(_step_update((1,), iter([frame((1, 1, 10.0), (9, 4, 2.0), (3, 2, 30.0))]), state))
    assert out == []
    state.mark = ms(5)
    out += _step_update((1,), iter([frame((7, 3, 35.0), (9, 5, 4.0))]), state)
    state.mark = ms(60)
    out += _step_update((1,), iter([]), state)
    made = pd.concat(out)
    assert made["increment"].tolist() == [0.0, 20.0, 5.0, 0.0, 2.0]
    assert made["reset"].tolist() == [False, False, False, True, False]
