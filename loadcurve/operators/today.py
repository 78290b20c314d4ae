"""Today's sessions.

``todays_sessions``: sessions cleaned by the "today" rules, spread over
5-minute slots, kept from local midnight to ``floor5(as_of)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadcurve.functions.timecols import as_ntz, day_start, floor_time, slot_index, slot_time
from loadcurve.operators.clean import clean_todays_sessions, newest_reports
from loadcurve.operators.ordered import global_row_number, time_slice
from loadcurve.operators.timegrid import expand_slots, slot_bounds


def _today_slots(as_of):
    """First and last slot of today so far."""
    now = as_ntz(as_of)
    return slot_index(day_start(now), 300, "floor"), slot_index(now, 300, "floor")


def todays_sessions(raw: DataFrame, as_of) -> DataFrame:
    s = clean_todays_sessions(raw, as_of)
    out = expand_slots(s, "startChargeTime", "finishChargeTime", s.columns, 300, time_col="Time",
                       within=_today_slots(as_of))
    return out.withColumn("Power_W", F.col("true_peakPower_W")).drop("slot")


def todays_reports(raw: DataFrame, as_of) -> DataFrame:
    """The reports that have a slot today so far: the sessions of :func:`todays_sessions`, not spread."""
    lo, hi = slot_bounds("startChargeTime", "finishChargeTime")
    first, last = _today_slots(as_of)
    return clean_todays_sessions(raw, as_of).filter(F.greatest(lo, first) <= F.least(hi, last))


def nested_series(raw: DataFrame, as_of) -> DataFrame:
    """per session, arrays of slot times and (constant) powers."""
    s = clean_todays_sessions(raw, as_of)
    lo, hi = slot_bounds("startChargeTime", "finishChargeTime")
    idx = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))
    return s.select(
        "dcosId",
        F.transform(idx, lambda i: slot_time(i)).alias("time_vals"),
        F.array_repeat(F.col("true_peakPower_W"), F.size(idx)).alias("power_vals"))


def explode_nested(nested: DataFrame, as_of) -> DataFrame:
    """Back from arrays to one row per slot, kept from midnight to ``floor5(as_of)``."""
    midnight, now5 = day_start(as_ntz(as_of)), floor_time(as_ntz(as_of), 300)
    z = nested.select("dcosId", F.explode(F.arrays_zip("time_vals", "power_vals")).alias("z"))
    return (z.select("dcosId", F.col("z.time_vals").alias("Time"), F.col("z.power_vals").alias("Power_W"))
             .filter((F.col("Time") >= midnight) & (F.col("Time") <= now5)))


def numbered_sessions(reports: DataFrame) -> DataFrame:
    """(dcosId, connectTime, user_no): sessions of the reports numbered by connect order."""
    firsts = reports.groupBy("dcosId").agg(F.min("connectTime").alias("connectTime"))
    return global_row_number(firsts, [F.col("connectTime"), F.col("dcosId")], "user_no", time_slice("connectTime"))


def todays_sessions_power(today: DataFrame) -> DataFrame:
    """Power per session and slot in kW, sessions labelled ``User #i`` by connect order."""
    return (today.select("dcosId", "Time", (F.col("Power_W") / 1000).alias("Power_kW"),
                         "vehicle_model", "choice", "userId")
                 .join(numbered_sessions(today).select("dcosId", "user_no"), "dcosId")
                 .withColumn("label", F.concat(F.lit("User #"), F.col("user_no").cast("string"))))


def energy_by_session_today(reports: DataFrame) -> DataFrame:
    """One row per session, then energy per vehicle model and its share.

    ``reports`` are today's (:func:`todays_reports`).  Of a session that was
    reported more than once the newest report counts (then the larger energy,
    then the later model name); sessions without an id all count.
    """
    per_session = newest_reports(reports, F.col("cumEnergy_Wh").desc(), F.col("vehicle_model").desc())
    by_model = per_session.groupBy("vehicle_model").agg(
        (F.coalesce(F.sum("cumEnergy_Wh"), F.lit(0.0)) / 1000).alias("energy_kWh"),
        F.count("*").alias("sessions"))
    # one row per vehicle model (a catalogue, not the data) -> the total fits one window
    total = F.sum("energy_kWh").over(Window.partitionBy())
    return by_model.withColumn("share", F.try_divide(F.col("energy_kWh"), total))
