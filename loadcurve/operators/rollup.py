"""Load curves: 5-minute demand and its hourly / daily / monthly roll-ups.

Plan (per key set ``by``):

1. sessions -> slots (``explode``), slots after ``floor5(as_of)`` cut;
2. ``groupBy(by, slot).sum`` with map-side partial sums: a hot key only ships
   one partial row per slot and map task;
3. gaps: ``lead(slot)`` over each key's *aggregated* slots, and every slot
   expands to itself plus the empty slots before the next one (the last one
   up to ``floor5(as_of)``) -- no spine join, and the session table is
   scanned once.

Roll-ups read the 5-minute table: mean power, summed energy, max peak, and
the first row's day / month name (A2-A4).  Months are labelled by their last
day at midnight, like ``resample("M")``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadcurve.functions.timecols import (
    as_ntz, day_start, hour_start, month_end, month_name, slot_index, slot_time, weekday_name,
)
from loadcurve.operators.timegrid import expand_slots, slot_bounds

STEP = 300


def slot_power(sessions: DataFrame, by=(), power_col: str = "true_peakPower_W",
               start_col: str = "startChargeTime", end_col: str = "finishChargeTime",
               closed: str = "both") -> DataFrame:
    """One row per session and 5-minute slot (by..., dcosId, slot, time, power_W)."""
    keep = list(by) + ["dcosId", F.col(power_col).alias("power_W")]
    return expand_slots(sessions, start_col, end_col, keep, STEP, closed)


def fill_forward(points: DataFrame, end_idx, by=()) -> DataFrame:
    """Gaps: each point also stands for the slots ``_s`` up to the next one (the last one up to ``end_idx``).

    The window runs over one key's aggregated points, a series bounded by its time span.
    """
    wk = Window.partitionBy(*by).orderBy("slot")
    return (points.withColumn("_next", F.coalesce(F.lead("slot").over(wk), end_idx + 1))
            .select(*points.columns, F.explode(F.sequence(F.col("slot"), F.col("_next") - 1)).alias("_s")))


def demand_watts(sessions: DataFrame, as_of, by=(), closed: str = "both",
                 power_col: str = "true_peakPower_W", method: str = "delta") -> DataFrame:
    """A1 + C3: summed power per slot, gap-free from the first slot to ``as_of``.

    ``method="delta"`` (default): two change rows per session (+power at its
    first slot, -power after its last), summed per (key, slot), then a running
    sum per key over the *aggregated* change points -- the shuffle carries two
    rows per session instead of one per slot.  Exact for whole-watt powers
    (cleaning rounds session power to 0 digits), so it equals ``"explode"``,
    which spreads every session over its slots first.
    """
    by = list(by)
    end_idx = slot_index(as_ntz(as_of), STEP, "floor")
    lo, hi = slot_bounds("startChargeTime", "finishChargeTime", STEP, closed)
    wk = Window.partitionBy(*by).orderBy("slot")
    if method == "delta":
        w = F.coalesce(F.col(power_col).cast("double"), F.lit(0.0))
        ends = sessions.filter(lo <= hi).select(*by, lo.alias("_lo"), hi.alias("_hi"), w.alias("_w"))
        deltas = (ends.select(*by, F.explode(F.array(
                      F.struct(F.col("_lo").alias("slot"), F.col("_w").alias("d")),
                      F.struct((F.col("_hi") + 1).alias("slot"), (-F.col("_w")).alias("d")))).alias("_e"))
                  .select(*by, "_e.slot", "_e.d")
                  .filter(F.col("slot") <= end_idx))
        points = (deltas.groupBy(*by, "slot").agg(F.sum("d").alias("d"))
                  .withColumn("w", F.sum("d").over(wk.rowsBetween(Window.unboundedPreceding, 0))))
        level = F.col("w")
    elif method == "explode":
        slots = (expand_slots(sessions, "startChargeTime", "finishChargeTime",
                              by + [F.col(power_col).alias("w")], STEP, closed, time_col=None)
                 .filter(F.col("slot") <= end_idx))
        points = slots.groupBy(*by, "slot").agg(F.sum("w").alias("w"))
        level = None
    else:
        raise ValueError(f"unknown method {method!r}")
    filled = fill_forward(points, end_idx, by)
    if level is None:   # explode: only the point's own slot has power, the gap is 0
        level = F.when(F.col("_s") == F.col("slot"), F.coalesce(F.col("w"), F.lit(0.0))).otherwise(F.lit(0.0))
    return filled.select(*by, slot_time(F.col("_s"), STEP).alias("time"), level.alias("w"))


def demand_features(watts: DataFrame, by=()) -> DataFrame:
    """C4: kW, kWh per 5 minutes, peak kW, weekday and month names."""
    w = F.col("w")
    return watts.select(
        *by, "time",
        (w / 1000).alias("avg_power_demand_kW"),
        ((w / 1000) / 12).alias("energy_demand_kWh"),
        (w / 1000).alias("peak_power_kW"),
        weekday_name("time").alias("day"),
        month_name("time").alias("month"))


def demand_5min(sessions: DataFrame, as_of, by=(), closed: str = "both", method: str = "delta") -> DataFrame:
    return demand_features(demand_watts(sessions, as_of, by, closed, method=method), by)


_GRAIN_KEY = {"hour": hour_start, "day": day_start, "month": month_end}


def rollup(d5: DataFrame, grain: str, by=()) -> DataFrame:
    """A2-A4: roll a 5-minute demand table up to ``hour``, ``day`` or ``month``."""
    key = _GRAIN_KEY[grain]("time")
    return (d5.groupBy(*by, key.alias("bucket"))
              .agg(F.avg("avg_power_demand_kW").alias("avg_power_demand_kW"),
                   F.sum("energy_demand_kWh").alias("energy_demand_kWh"),
                   F.max("peak_power_kW").alias("peak_power_kW"),
                   F.min("time").alias("_first"))
              # names of the bucket's first row (fixed-width buffer: stays a hash aggregate)
              .select(*by, F.col("bucket").alias("time"), "avg_power_demand_kW", "energy_demand_kWh",
                      "peak_power_kW", weekday_name("_first").alias("day"), month_name("_first").alias("month")))


def demand_tables(sessions: DataFrame, as_of, by=(), closed: str = "both") -> dict[str, DataFrame]:
    """A5: all granularities from the same 5-minute table."""
    d5 = demand_5min(sessions, as_of, by, closed)
    return {"demand_5min": d5,
            "demand_hourly": rollup(d5, "hour", by),
            "demand_daily": rollup(d5, "day", by),
            "demand_monthly": rollup(d5, "month", by)}
