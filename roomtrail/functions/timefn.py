"""Column expressions on time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def floor_ts(ts, seconds: int) -> Column:
    """Start of the ``seconds``-wide bucket (aligned to the epoch) holding ``ts``."""
    width = int(seconds) * 1_000_000
    return F.timestamp_micros(F.floor(F.unix_micros(_c(ts)) / F.lit(width)).cast("bigint") * F.lit(width))


def ceil_ts(ts, seconds: int) -> Column:
    width = int(seconds) * 1_000_000
    return F.timestamp_micros(F.ceil(F.unix_micros(_c(ts)) / F.lit(width)).cast("bigint") * F.lit(width))


def shift_ts(ts, seconds) -> Column:
    """``ts`` moved by a number of seconds (a literal or a column)."""
    delta = _c(seconds).cast("double") if isinstance(seconds, (str, Column)) else F.lit(float(seconds))
    return F.timestamp_micros(F.unix_micros(_c(ts)) + F.round(delta * 1_000_000).cast("bigint"))


def seconds_between(start, end) -> Column:
    return (F.unix_micros(_c(end)) - F.unix_micros(_c(start))) / F.lit(1_000_000.0)


def minutes_between(start, end) -> Column:
    return (F.unix_micros(_c(end)) - F.unix_micros(_c(start))) / F.lit(60_000_000.0)


def bins(start, end, seconds: int, closed: bool = False) -> Column:
    """Array of every bucket start touched by ``[start, end)`` (or ``[start, end]``).

    Empty for an empty interval, so it is safe under ``explode``.
    """
    s, e = _c(start), _c(end)
    if not closed:
        last = floor_ts(F.timestamp_micros(F.unix_micros(e) - 1), seconds)
        ok = s < e
    else:
        last = floor_ts(e, seconds)
        ok = s <= e
    first = floor_ts(s, seconds)
    step = F.expr(f"make_dt_interval(0, 0, 0, {int(seconds)})")
    empty = F.array().cast("array<timestamp>")
    return F.when(ok, F.sequence(first, last, step)).otherwise(empty)


def epoch_ts(value) -> Column:
    """Seconds or milliseconds since the epoch; values from 1e11 are milliseconds."""
    x = F.expr("try_cast(null as double)") if value is None else _c(value)
    x = x.try_cast("double")
    ms = F.when(x >= F.lit(1e11), x).otherwise(x * 1000)
    return F.timestamp_micros(F.round(ms * 1000).cast("bigint"))


def excel_or_text_ts(text) -> Column:
    """Spreadsheet day number (> 20000, counted from 1899-12-30) or date text."""
    t = F.trim(_c(text).cast("string"))
    number = t.try_cast("double")
    # a day number in a double is good to about a microsecond: keep milliseconds
    serial = F.timestamp_millis(F.round((number - F.lit(25569.0)) * F.lit(86_400_000.0)).cast("bigint"))
    return F.when(t.rlike(r"^\d+(\.\d+)?$") & (number > 20000), serial).otherwise(t.try_cast("timestamp"))


def local_ts(ts, zone) -> Column:
    return F.from_utc_timestamp(_c(ts), _c(zone) if isinstance(zone, Column) else zone)


def is_night(ts, start_hour: int = 22, end_hour: int = 7) -> Column:
    """True from ``start_hour`` over midnight until before ``end_hour``."""
    return (F.hour(_c(ts)) >= start_hour) | (F.hour(_c(ts)) < end_hour)


def sleep_night(local, evening_hour: int = 18) -> Column:
    """Date of the evening a local time belongs to."""
    day = F.to_date(_c(local))
    return F.when(F.hour(_c(local)) >= evening_hour, day).otherwise(F.date_sub(day, 1))


def noon_period_start(ts) -> Column:
    """Start of the noon-to-noon period holding ``ts``."""
    return shift_ts(floor_ts(shift_ts(ts, -43_200), 86_400), 43_200)
