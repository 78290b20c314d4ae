"""Declared schemas (the reference infers everything; this engine does not)."""

from pyspark.sql import types as T

SESSIONS_RAW = T.StructType([
    T.StructField("dcosId", T.LongType()),
    T.StructField("userId", T.StringType()),
    T.StructField("siteId", T.IntegerType()),
    T.StructField("stationId", T.LongType()),
    T.StructField("connectTime", T.TimestampNTZType()),
    T.StructField("startChargeTime", T.TimestampNTZType()),
    T.StructField("Deadline", T.TimestampNTZType()),
    T.StructField("lastUpdate", T.TimestampNTZType()),
    T.StructField("Duration", T.StringType()),
    T.StructField("DurationHrs", T.DoubleType()),
    T.StructField("cumEnergy_Wh", T.DoubleType()),
    T.StructField("peakPower_W", T.DoubleType()),
    T.StructField("choice", T.StringType()),
    T.StructField("vehicle_model", T.StringType()),
    T.StructField("sch_centsPerHr", T.LongType()),
    T.StructField("reg_centsPerHr", T.LongType()),
    T.StructField("user_email", T.StringType()),
    T.StructField("paymentId", T.LongType()),
])

PERSONAL_COLUMNS = ("user_email", "paymentId")

QUANTITIES = ("avg_power_demand_kW", "energy_demand_kWh", "peak_power_kW")

DEMAND_COLUMNS = ("time",) + QUANTITIES + ("day", "month")

FORECAST = T.StructType(
    [T.StructField("time", T.TimestampNTZType())]
    + [T.StructField(q + "_predictions", T.DoubleType()) for q in QUANTITIES])

KNN_PARAMS = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("series", T.StringType()),
    T.StructField("quantity", T.StringType()),
    T.StructField("best_depth", T.IntegerType()),
    T.StructField("best_n_neighbors", T.IntegerType()),
])
