"""Activity levels from steps, acceleration, or both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..env import durable
from ..functions.timefn import is_night
from . import kmeans
from .byvalue import pct_rank
from .quantiles import exact_quantiles

# Fixed values.
SEDENTARY, LIGHT, VIGOROUS, SLEEP = "Sedentary", "Light activity", "Moderate to Vigorous activity", "Sleep"
LEVELS = (SLEEP, SEDENTARY, LIGHT, VIGOROUS)
LOW_LEVELS = (SLEEP, SEDENTARY)
HIGH_LEVELS = (LIGHT, VIGOROUS)


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def _label(metric: Column, low: Column, high: Column) -> Column:
    return F.when(metric <= low, SEDENTARY).when(metric <= high, LIGHT).otherwise(VIGOROUS)


def activity_from_steps(windows: DataFrame, steps: str = "steps") -> DataFrame:
    """Cuts at the 40th and 80th percentile of active windows, kept in fixed
    ranges; low steps at night are sleep."""
    q = windows.groupBy("session_id").agg(
        F.percentile(F.when(F.col(steps) > 0, F.col(steps)), F.array(F.lit(0.4), F.lit(0.8))).alias("_q")
    )
    first, second = F.coalesce(F.col("_q")[0], F.lit(0.0)), F.coalesce(F.col("_q")[1], F.lit(0.0))
    cuts = q.select("session_id", _clamp(first, 10, 40).alias("_sed"), _clamp(second, 80, 180).alias("_light"))
    cuts = cuts.withColumn("_sleep", _clamp(F.col("_sed") / 2, 5, 15))
    out = windows.join(cuts, "session_id")
    sleep = is_night("w") & (F.col(steps) <= F.col("_sleep"))
    return out.withColumn("step_activity", F.when(sleep, SLEEP).otherwise(_label(F.col(steps), F.col("_sed"), F.col("_light")))).drop("_sed", "_light", "_sleep")


def activity_from_acc(windows: DataFrame, acc: str = "acc_std") -> DataFrame:
    """The same on acceleration spread, with unclamped 20/40/80 % cuts."""
    metric = F.coalesce(F.col(acc), F.lit(0.0))
    q = windows.groupBy("session_id").agg(
        F.percentile(F.when(metric > 0, metric), F.array(F.lit(0.2), F.lit(0.4), F.lit(0.8))).alias("_q")
    )
    zero = F.lit(0.0)
    cuts = q.select("session_id", *[F.coalesce(F.col("_q")[i], zero).alias(n) for i, n in enumerate(("_sleep", "_sed", "_light"))])
    out = windows.join(cuts, "session_id")
    sleep = is_night("w") & (metric <= F.col("_sleep"))
    return out.withColumn("acc_activity", F.when(sleep, SLEEP).otherwise(_label(metric, F.col("_sed"), F.col("_light")))).drop("_sed", "_light", "_sleep")


def activity_fused(windows: DataFrame, least_windows: int = 4) -> DataFrame:
    """Four clusters of a person's standardised (steps, acceleration, presence) features,
    ordered by median intensity; low combined motion at night is sleep.

    Every session has a model of its own, fitted on its windows with acceleration;
    sessions with fewer than ``least_windows`` of them are sedentary throughout."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    f = windows.withColumns(
        {
            "_steps": z("steps").cast("double"), "_std": z("acc_std") * 1.5, "_range": z("acc_range") * 1.5,
            "_hs": F.coalesce(F.col("step_samples") > 0, F.lit(False)).cast("double"), "_ha": F.coalesce(F.col("acc_count") > 0, F.lit(False)).cast("double"),
        }
    )
    features = ["_steps", "_std", "_range", "_hs", "_ha"]
    keys = ["session_id"]
    intensity = F.col("_std") + 0.40 * F.col("_range") + 1.25 * F.col("_steps")
    valid = kmeans.standardised(f.filter("_ha = 1"), keys, features).select(*keys, "w", "z", intensity.alias("_x"))
    valid = durable(valid)
    enough = valid.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least_windows)
    model = kmeans.fit(valid.join(enough, keys, "left_semi"), keys, [4], len(features), ["w"])
    fitted = durable(valid.join(model, keys).select(*keys, "w", "_x", kmeans.nearest(F.col("z"), F.col("centers")).alias("_cluster")))
    medians = exact_quantiles(fitted, [*keys, "_cluster"], "_x", {"_i": 0.5})
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_i", "_cluster"))  # four rows a session
    names = medians.withColumn("_rank", rank).select(*keys, "_cluster", F.when(F.col("_rank") <= 2, SEDENTARY).when(F.col("_rank") == 3, LIGHT).otherwise(VIGOROUS).alias("_name"))
    labelled = fitted.join(names, [*keys, "_cluster"]).select(*keys, "w", "_name")
    metric = z("acc_std") + z("steps")
    cut = windows.groupBy("session_id").agg(F.coalesce(F.percentile(F.when(metric > 0, metric), F.lit(0.2)), F.lit(0.0)).alias("_cut"))
    out = windows.join(labelled, ["session_id", "w"], "left").join(cut, "session_id")
    sleep = is_night("w") & (metric <= F.col("_cut"))
    return out.withColumn("fused_activity", F.when(sleep, SLEEP).otherwise(F.coalesce("_name", F.lit(SEDENTARY)))).drop("_name", "_cut")


def activity_context(df: DataFrame, room: str = "room") -> DataFrame:
    """Flag from room, night and the three activity estimates."""
    cols = ("step_activity", "acc_activity", "fused_activity")
    high = sum((F.coalesce(F.col(c).isin(*HIGH_LEVELS), F.lit(False)).cast("int") for c in cols), F.lit(0))
    low = sum((F.coalesce(F.col(c).isin(*LOW_LEVELS), F.lit(False)).cast("int") for c in cols), F.lit(0))
    where = F.coalesce(F.col(room), F.lit("Unknown"))
    flag = (
        F.when((where == "Bedroom") & is_night("w") & (low >= 2), "Bedroom + night + low activity")
        .when((where == "Bedroom") & (high > 0), "Bedroom + high activity")
        .when(where.isin("Indoor transition", "Out", "Other 2") & (high > 0), "Transition/Out + high activity")
        .when(F.coalesce(F.col("step_activity").isin(*LOW_LEVELS) & F.col("acc_activity").isin(*HIGH_LEVELS), F.lit(False)), "possible non-walking movement")
        .when(F.col("step_activity").eqNullSafe(F.col("acc_activity")), "step and acceleration agree")
        .otherwise("step and acceleration differ")
    )
    return df.withColumn("context", flag)


def level_distribution(df: DataFrame) -> DataFrame:
    """Windows per method and level, zeros included, with step/acc agreement."""
    cols = [c for c in ("step_activity", "acc_activity", "fused_activity") if c in df.columns]
    agree = F.avg((F.col("step_activity") == F.col("acc_activity")).cast("int"))
    flat = df.groupBy("session_id").agg(
        agree.alias("agreement"), *[F.sum((F.col(c) == lv).cast("bigint")).alias(f"{c}|{lv}") for c in cols for lv in LEVELS]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("method"), F.lit(lv).alias("level"), F.col(f"`{c}|{lv}`").alias("windows")) for c in cols for lv in LEVELS])
    return flat.select("session_id", "agreement", F.inline(rows))


def activity_disagreement(df: DataFrame, steps: str = "steps", acc: str = "acc_std", top: int | None = None) -> DataFrame:
    """Windows where the two labels differ, ranked per session by how far their step
    and acceleration ranks lie apart (unknown last); only the ``top`` first if given."""
    from pyspark.sql import Window

    # read three times by each ranking, so cut its lineage once
    d = durable(df.filter(F.col("step_activity") != F.col("acc_activity")))
    d = pct_rank(d, ["session_id"], steps, "_a")
    d = pct_rank(d, ["session_id"], acc, "_b")
    d = d.withColumn("score", F.abs(F.col("_a") - F.col("_b")))
    order = Window.partitionBy("session_id").orderBy(F.desc(F.round("score", 9)), "w")
    d = d.withColumn("rank", F.row_number().over(order)).drop("_a", "_b")
    return d if top is None else d.filter(F.col("rank") <= top)


def annotation_shapes(df: DataFrame, label: str, window_s: int, key: str = "activityLevel", author: str = "roomtrail", sensor: str = "Wearable") -> DataFrame:
    """Equal consecutive labels collapsed to annotation intervals, with the JSON
    text of each shape. Labels outside the allowed set count as sedentary; row
    order decides neighbours, as in the label files."""
    from .runs import _island, _session

    known = F.when(F.col(label).isin(*LEVELS), F.col(label)).otherwise(SEDENTARY)
    rows = df.select("session_id", "w", known.alias("label"))
    runs = _island(rows, F.col("label") != F.lag("label").over(_session())).groupBy("session_id", "_island", "label").agg(
        F.unix_millis(F.min("w")).alias("start"), (F.unix_millis(F.max("w")) + window_s * 1000).alias("end")
    )
    shape = F.to_json(F.struct(
        "start", "end", F.lit(author).alias("author"), F.lit(sensor).alias("sensor"), F.lit("timerange").alias("type"),
        F.create_map(F.lit(key), F.col("label")).alias("data"),
    ))
    return runs.select("session_id", "start", "end", "label", shape.alias("shape"))


def invalid_shapes(shapes: DataFrame, label: str = "label") -> DataFrame:
    """Shapes with start >= end, overlapping their predecessor, or with a label
    outside the allowed set; empty when all is well."""
    from pyspark.sql import Window

    prev = F.lag("end").over(Window.partitionBy("session_id").orderBy("start", "end"))
    problem = (
        F.when(F.col("start") >= F.col("end"), "invalid_interval")
        .when(F.col("start") < prev, "overlap")
        .when(~F.coalesce(F.col(label).isin(*LEVELS), F.lit(False)), "invalid_label")
    )
    return shapes.withColumn("problem", problem).filter("problem is not null")
