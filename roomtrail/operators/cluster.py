"""One-dimensional clustering of very many sessions in one job.

In one dimension clusters are contiguous in sorted order, so everything is said by
running counts and sums of a session's distinct values. Two clusters are the best
cut of all, found in one pass over those sums at any size. More clusters are found by
dynamic programming over places that close in on the cuts."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..env import durable
from ..functions.signal import finite
from . import kmeans
from .byvalue import prefix_by_value

def histogram(rows: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Distinct finite values with counts: repeated values merge before the shuffle."""
    return rows.select(*keys, finite(x).alias("x")).filter("x is not null").groupBy(*keys, "x").agg(F.count("*").alias("n"))


STEPS_PER_JOB = 6
#: Places of a key's sorted values at which cuts are first tried, and new places on either
#: side of a cut that is looked at more closely.
PLACES, CLOSER = 1024, 128


def kmeans1d_ordered(hist: DataFrame, keys: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """Model per (keys, k): ``uppers`` (largest value of every cluster but the last)
    and ``centers``, both ascending, and whether it ``converged``. Keys with fewer
    than k distinct values get no model. ``hist`` comes from :func:`histogram`.

    k = 2 is the exact optimum (ties: the smallest cut). Larger k are the exact optimum
    for keys of up to PLACES distinct values; see :func:`_best_cuts` for longer ones."""
    keys, ks = list(keys), sorted(ks)
    centred = hist.join(hist.groupBy(*keys).agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("_mean")), keys)
    centred = centred.withColumns({"_s": (F.col("x") - F.col("_mean")) * F.col("n"), "_one": F.lit(1)})
    sums = prefix_by_value(centred, keys, "x", {"cn": "n", "cs": "_s", "rank": "_one"})
    pre = durable(sums.select(*keys, "x", "_mean", "rank", F.col("cn").cast("double").alias("cn"), "cs"))
    done = []
    if 2 in ks:
        ends = centred.groupBy(*keys).agg(F.max("x").alias("x"), F.sum("n").cast("double").alias("cn"), F.sum("_s").alias("cs"), F.first("_mean").alias("_mean"))
        cuts = _cut_again(pre, ends.select(*keys, "_mean", F.array(F.struct("x", "cn", "cs")).alias("_cuts")), keys)
        done.append(_as_model(cuts.withColumn("k", F.lit(2)), keys).withColumn("converged", F.lit(True)))
    more = [k for k in ks if k > 2]
    if more:
        done.append(_best_cuts(pre, keys, more))
    return functools.reduce(DataFrame.unionByName, done)


def _cut_again(pre: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """One more cut per key, where the squared error falls most; keys without one go."""
    rows = pre.drop("_mean").join(cuts, keys).withColumn("_at", F.size(F.filter("_cuts", lambda c: c["x"] < F.col("x"))))  # the segment a value lies in
    on = F.when(F.col("_at") > 0, F.col("_cuts")[F.col("_at") - 1]["cn"]).otherwise(0.0)
    os = F.when(F.col("_at") > 0, F.col("_cuts")[F.col("_at") - 1]["cs"]).otherwise(0.0)
    end = F.col("_cuts")[F.col("_at")]
    n1, s1, n2, s2 = F.col("cn") - on, F.col("cs") - os, end["cn"] - F.col("cn"), end["cs"] - F.col("cs")
    gain = s1 * s1 / n1 + s2 * s2 / n2 - (s1 + s2) * (s1 + s2) / (n1 + n2)
    best = rows.filter(n2 > 0).groupBy(*keys).agg(F.max_by(F.struct("x", "cn", "cs"), F.struct(gain.alias("gain"), (-F.col("x")).alias("x"))).alias("_new"))
    return cuts.join(best, keys).select(*keys, "_mean", F.array_sort(F.array_append("_cuts", F.col("_new"))).alias("_cuts"))


def _as_model(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, uppers, centers) of cuts with running counts and sums."""
    before = F.concat(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("cn"), F.lit(0.0).alias("cs"))), F.expr("slice(_cuts, 1, size(_cuts) - 1)"))
    centers = F.zip_with("_cuts", before, lambda b, a: (b["cs"] - a["cs"]) / (b["cn"] - a["cn"]) + F.col("_mean"))
    return cuts.select(*keys, "k", F.expr("slice(_cuts.x, 1, size(_cuts) - 1)").alias("uppers"), centers.alias("centers"))


def optimal_cuts(cn: np.ndarray, cs: np.ndarray, k: int) -> list[int]:
    """Places of the k - 1 cuts that leave the least squared error, given running counts and
    sums at all places where one may cut (the last place is the end). Ties: smaller places."""
    n, s = np.concatenate([[0.0], cn]), np.concatenate([[0.0], cs])
    m = len(cn)
    best = np.full(m + 1, -np.inf)
    best[1:] = s[1:] ** 2 / n[1:]
    chosen = []
    for j in range(2, k + 1):
        new, at = np.full(m + 1, -np.inf), np.zeros(m + 1, np.int64)
        for lo in range(j, m + 1, 256):  # a strip of ends at a time
            ends = np.arange(lo, min(lo + 256, m + 1))
            cut = np.arange(j - 1, ends[-1])
            size = n[ends][None, :] - n[cut][:, None]
            total = s[ends][None, :] - s[cut][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(size > 0, best[cut][:, None] + total * total / size, -np.inf)
            pick = gain.argmax(axis=0)
            new[ends], at[ends] = gain[pick, np.arange(len(ends))], cut[pick]
        chosen.append(at)
        best = new
    cuts, end = [], m
    for at in reversed(chosen):
        end = int(at[end])
        cuts.append(end - 1)
    return cuts[::-1]


@F.pandas_udf(ArrayType(IntegerType()))
def _cuts_of(cn: pd.Series, cs: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([optimal_cuts(np.asarray(a), np.asarray(b), int(c)) for a, b, c in zip(cn, cs, k)])


def _spread(rank: str, low: str, width: str, places: int) -> str:
    """Whether a rank is one of about ``places`` evenly spread ones of the ``width`` after ``low``."""
    return f"(({rank} - {low}) * {places}) div {width} <> (({rank} - {low} - 1) * {places}) div {width}"


def _best_cuts(pre: DataFrame, keys: list[str], ks: Sequence[int], rounds: int = 12) -> DataFrame:
    """The best k - 1 cuts per (keys, k) by dynamic programming over running sums.

    Cuts may fall at PLACES evenly spread ranks of a key's distinct values, which are all of
    them for most keys. Where a cut has values between its place and the places beside it,
    CLOSER places on either side join in and the program runs again, until every cut has its
    neighbouring values for places: no value then lies on the wrong side of a cut. A task
    sees a key's places, never its values; the work grows with the logarithm of their number."""
    on = [*keys, "k"]
    place = F.struct("rank", "x", "cn", "cs")
    total = pre.groupBy(*keys).agg(F.max("rank").alias("_d"))
    first = pre.join(total, keys).filter(F.expr(_spread("rank", "0", "_d", PLACES)))
    runs = first.groupBy(*keys).agg(F.first("_mean").alias("_mean"), F.array_sort(F.collect_list(place)).alias("_p"))
    runs = runs.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).filter(F.size("_p") >= F.col("k"))
    sides = "flatten(transform(_c, i -> array(struct(if(i = 0, 0L, _p[i - 1].rank) AS lo, _p[i].rank AS hi), struct(_p[i].rank AS lo, _p[i + 1].rank AS hi))))"
    for _ in range(rounds):
        runs = durable(runs.withColumn("_c", _cuts_of("_p.cn", "_p.cs", "k")).withColumn("_w", F.expr(f"array_distinct(filter({sides}, w -> w.hi - w.lo > 1))")))
        open_ = runs.filter(F.size("_w") > 0)
        if open_.isEmpty():
            break
        inside = f"exists(_w, w -> rank > w.lo AND rank < w.hi AND {_spread('rank', 'w.lo', '(w.hi - w.lo)', CLOSER)})"
        extra = pre.drop("_mean").join(open_.select(*on, "_w"), keys).filter(F.expr(inside)).groupBy(*on).agg(F.collect_list(place).alias("_more"))
        nearer = F.when(F.col("_more").isNull(), F.col("_p")).otherwise(F.array_sort(F.array_union("_p", "_more")))
        runs = runs.drop("_c", "_w").join(extra, on, "left").withColumn("_p", nearer).drop("_more")
    ends = F.expr("concat(transform(_c, i -> _p[i]), array(_p[size(_p) - 1]))")
    model = runs.select(*on, "_mean", F.transform(ends, lambda p: F.struct(p["x"].alias("x"), p["cn"].alias("cn"), p["cs"].alias("cs"))).alias("_cuts"), (F.size("_w") == 0).alias("converged"))
    return _as_model(model, keys).join(model.select(*on, "converged"), on)


def label_of(x: Column, uppers: Column) -> Column:
    """1-based cluster of a value: one more than the number of uppers below it."""
    return F.size(F.filter(uppers, lambda u: u < x)) + 1


def silhouette1d(hist: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean Euclidean silhouette per (keys, k) by prefix sums.

    Own distance comes from running sums inside the cluster; the distance to
    another cluster is the distance to its mean, because clusters do not
    interleave. Members of singleton clusters score 0."""
    keys = list(keys)
    centred = hist.join(hist.groupBy(*keys).agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("_mean")), keys)
    centred = centred.withColumn("v", F.col("x") - F.col("_mean")).withColumn("_s", F.col("v") * F.col("n"))
    pre = prefix_by_value(centred, keys, "x", {"cn": "n", "cs": "_s"})
    lab = pre.join(model.select(*keys, "k", "uppers"), keys).withColumn("label", label_of(F.col("x"), F.col("uppers")))
    stats = lab.groupBy(*keys, "k", "label").agg(F.sum("n").alias("nc"), F.sum("_s").alias("sc"))
    before = Window.partitionBy(*keys, "k").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    around = Window.partitionBy(*keys, "k")
    stats = stats.withColumns(
        {
            "on": F.coalesce(F.sum("nc").over(before), F.lit(0)), "os": F.coalesce(F.sum("sc").over(before), F.lit(0.0)),
            "means": F.collect_list(F.struct("label", (F.col("sc") / F.col("nc")).alias("m"))).over(around),
        }
    )
    j = lab.join(stats, [*keys, "k", "label"])
    nl, sl = F.col("cn") - F.col("on"), F.col("cs") - F.col("os")
    dist = F.col("v") * nl - sl + (F.col("sc") - sl) - F.col("v") * (F.col("nc") - nl)
    a = F.greatest(dist, F.lit(0.0)) / (F.col("nc") - 1)
    b = F.array_min(F.transform(F.filter("means", lambda m: m["label"] != F.col("label")), lambda m: F.abs(m["m"] - F.col("v"))))
    top = F.greatest(a, b)
    score = F.when(F.col("nc") <= 1, F.lit(0.0)).otherwise(F.when(top > 0, (b - a) / top).otherwise(F.lit(0.0)))
    return j.withColumn("_score", score).groupBy(*keys, "k").agg((F.sum(F.col("_score") * F.col("n")) / F.sum("n")).alias("silhouette"))


def choose_ordered_clustering(
    rows: DataFrame, keys: Sequence[str], x: str, ks: Sequence[int], min_count: int, min_fraction: float, silhouette_min: float, near_best: float,
    borderline_min: float | None = None, borderline_ratio: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Pick a small ordered clustering per key, without labels.

    Returns (models, diagnostics). ``models`` has the selected (keys, k, uppers,
    centers, separation_tier) of keys where a candidate was accepted: every
    cluster large enough, and the silhouette strong, or borderline with centres
    far enough apart in ratio. Among accepted k the smallest within
    ``near_best`` of the best silhouette is taken."""
    keys = list(keys)
    hist = durable(histogram(rows, keys, x))
    total = hist.groupBy(*keys).agg(F.sum("n").alias("_n"), F.count("*").alias("_u"))
    tried = total.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).filter(F.col("_n") > F.col("k"))
    required = F.greatest(F.lit(int(min_count)), F.ceil(F.col("_n") * min_fraction).cast("int"))
    model = durable(kmeans1d_ordered(hist, keys, ks))
    sil = silhouette1d(hist, model, keys)
    lab = hist.join(model.select(*keys, "k", "uppers"), keys).withColumn("label", label_of(F.col("x"), F.col("uppers")))
    sizes = lab.groupBy(*keys, "k", "label").agg(F.sum("n").alias("_c")).groupBy(*keys, "k").agg(F.min("_c").alias("_min"))
    d = tried.join(model, [*keys, "k"], "left").join(sil, [*keys, "k"], "left").join(sizes, [*keys, "k"], "left").withColumn("required_cluster_count", required)
    ratio = F.array_min(F.expr("transform(sequence(1, size(centers) - 1), i -> exp(centers[i] - centers[i - 1]))"))
    d = d.withColumn("minimum_center_ratio", F.when(F.col("centers").isNotNull(), ratio))
    score = F.round("silhouette", 12)
    valid = F.coalesce(F.col("_min") >= F.col("required_cluster_count"), F.lit(False))
    strong = F.coalesce(score >= silhouette_min, F.lit(False))
    border = F.lit(False)
    if borderline_min is not None and borderline_ratio is not None:
        border = F.coalesce((score >= borderline_min) & (score < silhouette_min) & (F.col("minimum_center_ratio") >= borderline_ratio), F.lit(False))
    tier = F.when(valid & strong, "strong").when(valid & border, "borderline").when(F.col("centers").isNotNull(), "rejected")
    d = d.withColumns({"separation_tier": tier, "accepted": valid & (strong | border), "minimum_cluster_count": F.coalesce("_min", F.lit(0))})
    around = Window.partitionBy(*keys)
    best = F.max(F.when(F.col("accepted"), score)).over(around)
    fits = F.col("accepted") & (score >= F.round(best - near_best, 12))
    chosen = F.min(F.when(fits, F.col("k"))).over(around)
    d = d.withColumn("selected", F.coalesce(F.col("k") == chosen, F.lit(False)))
    d = durable(d.select(*keys, "k", "silhouette", "minimum_cluster_count", "required_cluster_count", "accepted", "separation_tier", "minimum_center_ratio", "uppers", "centers", "selected"))
    models = d.filter("selected").select(*keys, "k", "uppers", "centers", "separation_tier")
    return models, d


def assign_state(rows: DataFrame, models: DataFrame, keys: Sequence[str], x: str, output: str = "state") -> DataFrame:
    """State number of each row under its key's selected model; NULL without one."""
    m = models.select(*keys, F.col("k").alias("_k"), "uppers", "centers")
    out = rows.join(m, list(keys), "left")
    v = finite(x)
    return out.withColumn(output, F.when(v.isNotNull() & F.col("_k").isNotNull(), label_of(v, F.col("uppers")))).drop("uppers").withColumnRenamed("_k", f"{output}_k").withColumnRenamed("centers", f"{output}_centers")


def classify_movement(windows: DataFrame, params, value: str = "movement_value", source: str = "movement_source") -> tuple[DataFrame, DataFrame]:
    """Movement states 1..K per session from acceleration or steps; low motion is
    state 1; windows without a value have none. Returns (windows with movement_* columns, diagnostics)."""
    x = F.when(F.col(source) == "acc", F.log(F.greatest(F.col(value), F.lit(1e-6)))).when(F.col(source) == "step", F.log1p(F.greatest(F.col(value), F.lit(0.0))))
    # greatest() passes over nulls: a window without a value has no state
    rows = windows.withColumn("_x", F.when(F.col(value).isNotNull(), x))
    models, diag = choose_ordered_clustering(
        rows, ["session_id"], "_x", params.movement_candidates, params.min_movement_cluster_windows, params.min_cluster_fraction,
        params.movement_silhouette_min, params.near_best_silhouette,
    )
    out = assign_state(rows, models, ["session_id"], "_x", "movement_state").withColumnRenamed("movement_state_k", "movement_k")
    boundary = (F.col("movement_state_centers")[0] + F.col("movement_state_centers")[1]) / 2
    out = out.withColumns(
        {
            "movement_resolved": F.col("movement_k").isNotNull(),
            "low_motion": F.coalesce(F.col("movement_state") == 1, F.lit(False)),
            "low_motion_threshold": F.when(F.col(source) == "acc", F.exp(boundary)).otherwise(F.expm1(boundary)),
        }
    )
    return out.drop("_x", "movement_state_centers"), diag


def quantile_lloyd(
    rows: DataFrame, keys: Sequence[str], x: str, k: int, low: float = 0.05, high: float = 0.95, rounds: int = 200, tolerance: float = 1e-12, median: bool = False,
) -> DataFrame:
    """Lloyd iteration from quantile seeds for all keys at once: (keys, centers).

    Several steps are chained lazily per job; a job ends in a durable table of
    one row per key and the only thing the driver sees is whether any centre
    still moves. Empty clusters keep their centre. ``median`` gives K-medians."""
    keys = list(keys)
    hist = durable(histogram(rows, keys, x))
    probs = [low + (high - low) * i / (k - 1) for i in range(k)] if k > 1 else [0.5]
    model = hist.groupBy(*keys).agg(F.percentile("x", F.array(*[F.lit(p) for p in probs]), F.col("n")).alias("centers")).withColumn("_moved", F.lit(True))
    done = 0
    while done < rounds:
        for _ in range(min(STEPS_PER_JOB, rounds - done)):
            near = F.transform("centers", lambda c: F.abs(F.col("x") - c))
            seen = hist.join(model, keys).withColumn("_l", F.array_position(near, F.array_min(near)).cast("int"))
            mean = F.percentile("x", F.lit(0.5), F.col("n")) if median else F.sum(F.col("x") * F.col("n")) / F.sum("n")
            per = seen.groupBy(*keys, "_l").agg(mean.alias("_c"), F.first("centers").alias("centers"))
            packed = per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_l", "_c"))).alias("_m"), F.first("centers").alias("_old"))
            new = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.coalesce(F.try_element_at("_m", i), F.element_at("_old", i)))
            shift = F.array_max(F.zip_with(new, F.col("_old"), lambda a, b: F.abs(a - b)))
            model = packed.select(*keys, new.alias("centers"), (shift >= tolerance).alias("_moved"))
            done += 1
        model = durable(model)
        if model.filter("_moved").isEmpty():
            break
    return model.select(*keys, F.array_sort("centers").alias("centers"))


def log_boundaries(centers: Column, base: str = "e") -> Column:
    """Back-transformed midpoints between neighbouring centres of log values."""
    mid = F.transform(F.sequence(F.lit(1), F.size(centers) - 1), lambda i: (F.element_at(centers, i) + F.element_at(centers, i + 1)) / 2)
    return F.transform(mid, lambda m: F.pow(F.lit(10.0), m) if base == "10" else F.exp(m))


def kmedians_trim(rows: DataFrame, keys: Sequence[str], x: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Two-centre K-medians after trimming to the given quantiles, seeded at the
    quartiles: (keys, centers)."""
    return quantile_lloyd(trim(rows, keys, x, low, high), keys, x, 2, 0.25, 0.75, 100, 1e-6, median=True)


def trim(rows: DataFrame, keys: Sequence[str], x: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows between two quantiles of their key (both included)."""
    cut = rows.groupBy(*keys).agg(F.percentile(x, F.array(F.lit(low), F.lit(high))).alias("_q"))
    return rows.join(cut, list(keys)).filter((F.col(x) >= F.col("_q")[0]) & (F.col(x) <= F.col("_q")[1])).drop("_q")


def bootstrap_median_ci(rows: DataFrame, keys: Sequence[str], x: str, replicates: int = 1000, confidence: float = 0.95, seed: int = 20260703) -> DataFrame:
    """Percentile interval of the bootstrap median.

    The median of a resample of n sorted values is the value at a random rank:
    the middle order statistic of n uniform draws, which is Beta distributed.
    So per key only ``replicates`` ranks are drawn, and they look up the sorted
    values by position; no row is ever copied per replicate."""
    keys = list(keys)
    hist = durable(histogram(rows, keys, x))
    pre = prefix_by_value(hist, keys, "x", {"upto": "n"})
    total = hist.groupBy(*keys).agg(F.sum("n").alias("_n"))

    @F.pandas_udf("array<struct<r:int,a:bigint,b:bigint>>")
    def ranks(n: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for size, key in zip(n, h):
            rng = np.random.default_rng([seed, int(key) & 0xFFFFFFFF])
            k = (size + 1) // 2
            u = rng.beta(k, size - k + 1, replicates)
            a = np.minimum((u * size).astype(int), size - 1)
            if size % 2:
                b = a
            else:  # the next order statistic given this one
                v = 1 - (1 - u) * rng.random(replicates) ** (1 / (size - k))
                b = np.minimum((v * size).astype(int), size - 1)
            out.append([{"r": i, "a": int(p), "b": int(q)} for i, (p, q) in enumerate(zip(a, b))])
        return pd.Series(out)

    drawn = total.filter("_n >= 2").select(*keys, "_n", F.inline(ranks("_n", F.xxhash64(*keys) if keys else F.lit(0))))
    asked = drawn.select(*keys, "_n", "r", F.explode(F.array("a", "b")).alias("rank"))
    # positions in blocks of a 1/1000 of the key: a value spans at most 1001 blocks
    block = F.greatest(F.floor(F.col("_n") / 1000), F.lit(1)).cast("bigint")
    spans = pre.join(total, keys).withColumn("_from", F.col("upto") - F.col("n"))
    spans = spans.withColumn("_bl", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("upto") - 1) / block))))
    hit = asked.withColumn("_bl", F.floor(F.col("rank") / block)).join(spans.select(*keys, "_bl", "_from", "upto", "x"), [*keys, "_bl"])
    hit = hit.filter((F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("upto")))
    medians = hit.groupBy(*keys, "r").agg(F.avg("x").alias("_m"))
    alpha = (1 - confidence) / 2
    q = medians.groupBy(*keys).agg(F.percentile("_m", F.array(F.lit(alpha), F.lit(1 - alpha))).alias("_q"))
    return q.select(*keys, F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))


# Why a candidate number of clusters was not taken.
REASONS = ("ok", "small cluster", "not enough training windows")


def rssi_vector_kmeans(
    vectors: DataFrame, features: Sequence[str], ks: Sequence[int] = tuple(range(3, 9)), min_fraction: float = 0.05, training: str = "training", keys: Sequence[str] = ("session_id",),
    order: Sequence[str] = ("w",),
) -> tuple[DataFrame, DataFrame]:
    """K-means of each person's standardised low-motion vectors, the number of clusters
    chosen per person; predicts every row with signal. Returns (rows with ``cluster``
    from 0, candidates with the selected one marked).

    A candidate is valid if its smallest cluster holds ``min_fraction`` of the training
    rows. The best silhouette (squared Euclidean) among valid candidates wins, among
    all tried ones if none is valid; ties go to fewer clusters. People without a
    candidate have no cluster."""
    keys, size = list(keys), len(features)
    z = durable(kmeans.standardised(vectors, keys, features, training=F.col(training)))
    train = durable(z.filter(training).select(*keys, *order, "z"))
    totals = train.groupBy(*keys).agg(F.count("*").alias("_rows"))
    on = [*keys, "k"]
    enough = totals.join(totals.select(*keys, F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k")), keys)
    models = kmeans.fit(train, keys, ks, size, order).join(enough.filter(F.col("_rows") > F.col("k")).select(*on), on, "left_semi")
    fitted = train.join(models, keys).withColumn("cluster", kmeans.nearest(F.col("z"), F.col("centers")))
    table = enough.join(models, on, "left").join(kmeans.silhouette(fitted, on, "cluster", size), on, "left").withColumnRenamed("k", "candidate_k")
    share = F.col("smallest") / F.col("_rows")
    valid = F.coalesce((share >= min_fraction) & (F.col("clusters") == F.col("candidate_k")), F.lit(False))
    reason = F.when(F.col("centers").isNull(), REASONS[2]).when(valid, REASONS[0]).otherwise(REASONS[1])
    table = table.withColumns({"valid_candidate": valid, "min_cluster_fraction": share, "reason": reason, "silhouette_kind": F.lit("squared_euclidean")})
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("valid_candidate"), F.desc_nulls_last(F.round("silhouette", 12)), "candidate_k"))
    table = durable(table.withColumn("selected", (rank == 1) & F.col("centers").isNotNull()))
    best = table.filter("selected").select(*keys, "centers")
    cluster = F.when(F.col("has_rssi"), kmeans.nearest(F.col("z"), F.col("centers")) - 1)
    out = z.join(best, keys, "left").withColumn("cluster", cluster).drop("z", "centers")
    return out, table.drop("_rows", "smallest", "clusters", "centers")
