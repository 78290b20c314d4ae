"""Session -> regular slots, and gap-free time spines.

A session is spread over the 5-minute slots from its rounded start to its
rounded finish, both ends included (the reference's fence-post; ``closed=
"left"`` drops the last slot).  Slots are generated with an integer
``sequence`` + ``explode``: no Python, and at most 289 rows per session
because sessions longer than a day are removed by cleaning.  An inverted
range yields no slot (``sequence`` itself would fail, so it is guarded).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcurve.functions.timecols import slot_index, slot_time


def _guarded_range(lo, hi):
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))


def slot_bounds(start_col: str, end_col: str, step_seconds: int = 300, closed: str = "both"):
    lo = slot_index(start_col, step_seconds, "round")
    hi = slot_index(end_col, step_seconds, "round")
    if closed == "left":
        hi = hi - 1
    elif closed != "both":
        raise ValueError(f"closed must be 'both' or 'left', not {closed!r}")
    return lo, hi


def expand_slots(df: DataFrame, start_col: str, end_col: str, keep: list[str],
                 step_seconds: int = 300, closed: str = "both",
                 index_col: str = "slot", time_col: str | None = "time", within=None) -> DataFrame:
    """One row per (session, slot) with the ``keep`` columns carried along.

    ``within`` (first and last slot) cuts the range before it is spread.
    """
    lo, hi = slot_bounds(start_col, end_col, step_seconds, closed)
    if within is not None:
        lo, hi = F.greatest(lo, within[0]), F.least(hi, within[1])
    out = df.select(*keep, F.explode(_guarded_range(lo, hi)).alias(index_col))
    if time_col:
        out = out.withColumn(time_col, slot_time(F.col(index_col), step_seconds))
    return out


def regular_spine(bounds: DataFrame, lo_col: str, hi_col: str, step_seconds: int,
                  by: list[str] | tuple = (), time_col: str = "time") -> DataFrame:
    """All step-aligned times from ``lo`` to ``hi`` (inclusive) per key row.

    The length of one key's spine is bounded by its time span, not by the
    data volume; many keys spread over the partitions of ``bounds``.
    """
    lo = slot_index(lo_col, step_seconds, "floor")
    hi = slot_index(hi_col, step_seconds, "floor")
    return (bounds.select(*by, F.explode(_guarded_range(lo, hi)).alias("_i"))
            .select(*by, slot_time(F.col("_i"), step_seconds).alias(time_col)))

