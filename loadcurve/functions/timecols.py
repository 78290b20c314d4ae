"""Wall-clock time helpers on ``TIMESTAMP_NTZ``.

All arithmetic goes through microseconds since 1970-01-01 (an NTZ literal),
so no session time zone can move a value.  Rounding to a step is half-to-even
(the way pandas rounds timestamps); floors use integer ``pmod``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_SQL = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
US_PER_S = 1_000_000


def _epoch() -> Column:
    return F.expr(_EPOCH_SQL)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_ntz(value) -> Column:
    """Literal or column as ``TIMESTAMP_NTZ`` (strings 'YYYY-MM-DD[ hh:mm:ss]')."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, _dt.date):
        value = value.strftime("%Y-%m-%d")
    return F.lit(str(value)).cast("timestamp_ntz")


def epoch_micros(col) -> Column:
    return F.timestamp_diff("MICROSECOND", _epoch(), _c(col))


def from_epoch_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us.cast("long"), _epoch())


def round_time(col, step_seconds: int = 300) -> Column:
    """Nearest multiple of the step; exact halves go to the even multiple."""
    step = step_seconds * US_PER_S
    return from_epoch_micros(F.bround(epoch_micros(col) / F.lit(float(step)), 0).cast("long") * step)


def floor_time(col, step_seconds: int) -> Column:
    step = step_seconds * US_PER_S
    us = epoch_micros(col)
    return from_epoch_micros(us - F.pmod(us, F.lit(step)))


def slot_index(col, step_seconds: int = 300, how: str = "round") -> Column:
    """Index of the step containing / nearest to a time (long)."""
    step = step_seconds * US_PER_S
    us = epoch_micros(col)
    if how == "round":
        return F.bround(us / F.lit(float(step)), 0).cast("long")
    return F.floor(us / F.lit(step)).cast("long") if how == "floor" else F.ceil(us / F.lit(step)).cast("long")


def slot_time(idx: Column, step_seconds: int = 300) -> Column:
    return from_epoch_micros(idx * F.lit(step_seconds * US_PER_S))


def hour_start(col) -> Column:
    return floor_time(col, 3600)


def day_start(col) -> Column:
    return floor_time(col, 86400)


def month_end(col) -> Column:
    """Midnight of the last day of the month (pandas ``resample('M')`` label)."""
    return F.last_day(F.to_date(_c(col))).cast("timestamp_ntz")


def weekday_name(col) -> Column:
    return F.date_format(_c(col), "EEEE")


def month_name(col) -> Column:
    return F.date_format(_c(col), "MMMM")
