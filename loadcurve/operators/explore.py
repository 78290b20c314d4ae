"""Range queries over series and session tables.

Bounds are compared as timestamps: a 'YYYY-MM-DD' end bound means midnight,
so the rest of that day is left out, as in the reference (N11);
``end_inclusive_day=True`` keeps the whole end day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcurve.functions.timecols import as_ntz

# Label column shown next to each granularity.
LABEL_COLUMN = {"demand_5min": "day", "demand_hourly": "day", "demand_daily": "day", "demand_monthly": "month"}


def _to_dt(x) -> dt.datetime:
    if isinstance(x, dt.datetime):
        return x
    if isinstance(x, dt.date):
        return dt.datetime(x.year, x.month, x.day)
    s = str(x)
    for fmt in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%m/%d/%Y"):
        try:
            return dt.datetime.strptime(s, fmt)
        except ValueError:
            pass
    raise ValueError(f"unrecognised date {x!r}")


def between_dates(df: DataFrame, col: str = "time", start=None, end=None,
                  end_inclusive_day: bool = False, month_partition: str = "ym") -> DataFrame:
    """Rows with ``col`` in the bounds; on a table partitioned by month (column
    ``month_partition``, 'YYYY-MM', as ``jobs.refresh`` writes it) the same bounds
    are added on the partition column, so whole months are pruned at planning."""
    c = F.col(col)
    part = month_partition if month_partition in df.columns else None
    if start is not None:
        s = _to_dt(start)
        df = df.filter(c >= as_ntz(s))
        if part:
            df = df.filter(F.col(part) >= F.lit(s.strftime("%Y-%m")))
    if end is not None:
        e = _to_dt(end)
        df = df.filter(c < as_ntz(e + dt.timedelta(days=1)) if end_inclusive_day else c <= as_ntz(e))
        if part:
            last = e + dt.timedelta(days=1) if end_inclusive_day else e
            df = df.filter(F.col(part) <= F.lit(last.strftime("%Y-%m")))
    return df


def series_range(table: DataFrame, granularity: str, quantity: str, start=None, end=None,
                 by=()) -> DataFrame:
    """One quantity and its label column of a demand table, within a date range."""
    label = LABEL_COLUMN[granularity]
    keep = ["ym"] if "ym" in table.columns else []
    out = between_dates(table.select(*by, "time", quantity, label, *keep), "time", start, end)
    return out.drop(*keep)


def relative_range(kind: str, as_of, n_days: int = 7) -> tuple[dt.datetime | None, dt.datetime | None]:
    """P10: date bounds of the quick-range buttons at ``as_of`` (date part only)."""
    d = _to_dt(as_of)
    day = dt.datetime(d.year, d.month, d.day)
    tomorrow = day + dt.timedelta(days=1)
    if kind == "last_days":
        return day - dt.timedelta(days=n_days), tomorrow
    if kind == "month":
        return day.replace(day=1), tomorrow
    if kind == "year":
        return day.replace(month=1, day=1), tomorrow
    if kind == "all":
        return None, None
    raise ValueError(f"unknown range {kind!r}")


def series_relative_range(table: DataFrame, granularity: str, quantity: str, kind: str, as_of,
                          n_days: int = 7, by=()) -> DataFrame:
    start, end = relative_range(kind, as_of, n_days)
    return series_range(table, granularity, quantity, start, end, by)
