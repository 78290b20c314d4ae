"""Charger status.

The reference builds the table from eight left merges on ``stationId``.
Here it is one numeric ``groupBy("stationId")`` (conditional sums for today,
partial-aggregated map-side, so a busy station costs one partial row per map
task) and one left join with the newest *fresh* report per station -- a
window over the reports of the last 16 minutes only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadcurve.functions.scalars import state_text
from loadcurve.functions.timecols import as_ntz, day_start

# Fixed values of the reference: site of the station grid, freshness pad
# (minutes) and rated charger power (W).
DEFAULT_SITE = 25
FRESH_MINUTES = 16
RATED_POWER_W = 6600.0


def in_use_flag(as_of, fresh_minutes: float = FRESH_MINUTES):
    """Age of ``lastUpdate`` at ``as_of`` within the pad (no upper bound on the time, as the reference).

    Written as ``lastUpdate >= <literal>`` so that on a stored session table the
    filter reaches the parquet scan and skips old row groups.
    """
    bound = F.timestamp_add("MICROSECOND", F.lit(-int(fresh_minutes * 60 * 1_000_000)), as_ntz(as_of))
    return F.col("lastUpdate") >= bound


def charger_status(sessions: DataFrame, as_of, site: int | None = DEFAULT_SITE,
                   fresh_minutes: float = FRESH_MINUTES, rated_power_w: float = RATED_POWER_W,
                   by=()) -> DataFrame:
    by = list(by)
    x = sessions if site is None else sessions.filter(F.col("siteId") == site)
    x = x.filter(F.col("stationId").isNotNull())
    fresh = in_use_flag(as_of, fresh_minutes)
    today = F.col("finishChargeTime") >= day_start(as_ntz(as_of))
    # numeric per-station sums: a hash aggregate with map-side partial sums
    sums = x.groupBy(*by, "stationId").agg(
        F.max(F.when(fresh, 1).otherwise(0)).alias("inUse"),
        F.coalesce(F.sum("cumEnergy_Wh"), F.lit(0.0)).alias("cumEnergy_Wh"),
        F.coalesce(F.sum(F.when(today, F.col("cumEnergy_Wh"))), F.lit(0.0)).alias("todayEnergy_Wh"),
        F.coalesce(F.sum(F.when(today, F.col("DurationHrs"))), F.lit(0.0)).alias("_today_h"))
    # the in-use row: newest fresh report per station (ties: smaller dcosId); fresh
    # reports are the last 16 minutes only, a small set
    w = Window.partitionBy(*by, "stationId").orderBy(F.col("lastUpdate").desc(), F.col("dcosId"))
    latest = (x.filter(fresh).withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1)
               .select(*by, "stationId", F.col("true_peakPower_W").alias("currentChargingRate"), "choice",
                       "vehicle_model",
                       # prices of the current session; null when idle, so doubles (as after a left merge)
                       F.col("sch_centsPerHr").cast("double").alias("sch_centsPerHr"),
                       F.col("reg_centsPerHr").cast("double").alias("reg_centsPerHr")))
    return sums.join(latest, [*by, "stationId"], "left").select(
        *by, "stationId", "inUse", "currentChargingRate", "choice", "vehicle_model", "sch_centsPerHr",
        "reg_centsPerHr", "cumEnergy_Wh", "todayEnergy_Wh",
        (F.col("todayEnergy_Wh") / (rated_power_w * 24)).alias("currPowerUtilRate"),
        (F.col("_today_h") / 24).alias("currOccupUtilRate"),
        state_text("inUse").alias("state"))


def charger_utilization(chargers: DataFrame) -> DataFrame:
    """Per-charger cumulative / today's kWh and utilisation percentages."""
    return chargers.select(
        "stationId",
        (F.col("cumEnergy_Wh") / 1000).alias("cumEnergy_kWh"),
        (F.col("todayEnergy_Wh") / 1000).alias("todayEnergy_kWh"),
        (F.col("currPowerUtilRate") * 100).alias("power_util_pct"),
        (F.col("currOccupUtilRate") * 100).alias("occupancy_util_pct"))
