"""Inputs derived from the driver's test tables (see FIXTURES.md).

``sessions_raw``: one ``events`` row = one charging session, as of
``AS_OF``.  ``hourly_series`` / ``daily_series``: regular series for the
forecasting operators.  All derivations are projections and aggregations, so
they grow with the tables they read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcurve.functions.timecols import floor_time, hour_start
from loadcurve.operators.timegrid import regular_spine

AS_OF = dt.datetime(2024, 1, 30, 12, 0, 0)
DAILY_AS_OF = dt.datetime(2001, 7, 15, 12, 0, 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dhms(secs) -> F.Column:
    """'<d> days HH:MM:SS' of a non-negative number of seconds."""
    return F.format_string(
        "%d days %02d:%02d:%02d",
        F.floor(secs / 86400).cast("int"), F.floor(F.pmod(secs, 86400) / 3600).cast("int"),
        F.floor(F.pmod(secs, 3600) / 60).cast("int"), F.pmod(secs, 60).cast("int"))


def sessions_from_events(events: DataFrame) -> DataFrame:
    """Every event as a session; what is later than a moment is cut by the operators, not here."""
    e = F.col("event_id")
    start = floor_time("ts", 1)
    secs = F.floor(F.col("value") * 180).cast("long")
    return (events
            .select(
                e.alias("dcosId"),
                F.col("user_id").cast("string").alias("userId"),
                F.when(e % 10 == 0, 99).otherwise(25).cast("int").alias("siteId"),
                (e % 8 + 1).cast("long").alias("stationId"),
                F.timestamp_add("MINUTE", F.lit(-2), start).alias("connectTime"),
                start.alias("startChargeTime"),
                F.when(e % 47 == 0, F.lit(None).cast("timestamp_ntz"))
                 .otherwise(F.timestamp_add("HOUR", (1 + e % 12).cast("int"), start)).alias("Deadline"),
                F.timestamp_add("SECOND", secs, start).alias("lastUpdate"),
                _dhms(secs).alias("Duration"),
                (F.col("value") / 20).alias("DurationHrs"),
                F.when(e % 50 == 0, F.lit(0.0)).when(e % 53 == 0, F.lit(None).cast("double"))
                 .otherwise(((e * 37) % 40000 + 500).cast("double")).alias("cumEnergy_Wh"),
                F.when(e % 61 == 0, F.lit(0.0)).otherwise(F.lit(6600.0)).alias("peakPower_W"),
                F.when(F.col("event_type").isin("purchase", "signup"), "SCHEDULED")
                 .otherwise("REGULAR").alias("choice"),
                F.when(e % 59 == 0, F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("model_"), (F.col("user_id") % 25).cast("string"))).alias("vehicle_model"),
                (100 + 10 * (e % 5)).cast("long").alias("sch_centsPerHr"),
                (150 + 10 * (e % 7)).cast("long").alias("reg_centsPerHr"),
                F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.org")).alias("user_email"),
                e.alias("paymentId"),
            ))


def sessions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions_from_events(table(spark, sf_dir, "events"))


def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sum(value)`` per hour from the first event's to the last one's, empty hours 0: (time, i, v)."""
    ev = table(spark, sf_dir, "events").filter("ts is not null").select(hour_start("ts").alias("time"), "value")
    bounds = ev.agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    spine = regular_spine(bounds, "lo", "hi", step_seconds=3600, by=["lo"])
    sums = (spine.select("time", "lo", F.lit(0.0).alias("value"))
            .unionByName(ev, allowMissingColumns=True)
            .groupBy("time").agg(F.sum("value").alias("v"), F.max("lo").alias("lo")))
    return sums.select("time", F.timestamp_diff("HOUR", F.col("lo"), F.col("time")).cast("long").alias("i"), "v")


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sum(o_totalprice)`` per day from the first order's to the last one's, empty days 0: (time, v)."""
    o = table(spark, sf_dir, "orders").filter("o_orderdate is not null").select(
        floor_time("o_orderdate", 86400).alias("time"), F.col("o_totalprice").alias("value"))
    spine = regular_spine(o.agg(F.min("time").alias("lo"), F.max("time").alias("hi")), "lo", "hi", step_seconds=86400)
    return (spine.select("time", F.lit(0.0).alias("value")).unionByName(o)
            .groupBy("time").agg(F.sum("value").alias("v")))
