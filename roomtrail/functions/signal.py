"""Column expressions on sensor values and evidence scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
METRES_PER_HPA = -8.3
SPIKE_LIMIT = 1.2
SPIKE_REPLACEMENT = 1.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x, low: float | None = None, high: float | None = None) -> Column:
    """Limit to ``[low, high]``; NULL stays NULL."""
    c = _c(x)
    out = c
    if low is not None:
        out = F.when(c < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(c > high, F.lit(float(high))).otherwise(out)
    return F.when(c.isNotNull(), out)


def finite(x) -> Column:
    """NaN and infinities become NULL, the library's only missing value."""
    c = _c(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def magnitude(x, y, z) -> Column:
    x, y, z = _c(x), _c(y), _c(z)
    return F.sqrt(x * x + y * y + z * z)


def spike_clip(x, limit: float = SPIKE_LIMIT, mode: str = "replace") -> Column:
    """``replace`` puts 1.0 for a spike, ``cap`` cuts it at the limit."""
    c = _c(x)
    if mode == "cap":
        return F.least(c, F.lit(limit))
    return F.when(c > limit, F.lit(SPIKE_REPLACEMENT)).otherwise(c)


def pressure_height(hpa_difference) -> Column:
    return _c(hpa_difference) * F.lit(METRES_PER_HPA)


def rssi_confidence(dominance, gap_db) -> Column:
    return F.lit(0.60) * clip(F.coalesce(_c(dominance), F.lit(0.0)), 0, 1) + F.lit(0.40) * (
        clip(F.coalesce(_c(gap_db), F.lit(0.0)), 0, 15) / 15
    )


def cluster_confidence(gap_db, has_rssi) -> Column:
    """Variant used with vector clusters: gap plus presence."""
    return F.lit(0.40) * (clip(F.coalesce(_c(gap_db), F.lit(0.0)), 0, 15) / 15) + F.lit(0.60) * _c(has_rssi).cast("double")


def location_confidence_score(steps, stability, gap_db) -> Column:
    return (
        F.lit(0.40) * F.greatest(F.lit(0.0), F.lit(1.0) - F.least(_c(steps), F.lit(100.0)) / 100.0)
        + F.lit(0.40) * clip(stability, 0, 1)
        + F.lit(0.20) * (clip(gap_db, 0, 10) / 10.0)
    )


def location_confidence_label(steps, stability, gap_db) -> Column:
    steps, stability, gap_db = _c(steps), _c(stability), _c(gap_db)
    return (
        F.when((steps <= 10) & (stability >= 0.70) & (gap_db >= 3.0), "High")
        .when((steps <= 100) & (stability >= 0.50) & (gap_db >= 1.0), "Medium")
        .otherwise("Low")
    )


def log_steps(steps) -> Column:
    return F.log1p(F.greatest(F.coalesce(_c(steps).cast("double"), F.lit(0.0)), F.lit(0.0)))


def step_line_width(steps, upper) -> Column:
    """``log1p`` steps over ``upper`` (a 98th percentile of ``log_steps``), at
    most 1, mapped to 1.8..9.6; 2.5 where no scale exists."""
    up = _c(upper)
    scaled = F.lit(1.8) + F.lit(7.8) * F.least(log_steps(steps) / up, F.lit(1.0))
    return F.when(up.isNull() | (up <= 0), F.lit(2.5)).otherwise(scaled)
