"""Forecast tables: empty table, upsert, clamp, actual vs forecast, today's peak.

Upsert rule (A18): per time bucket and per column, the value of the latest
run that is not null -- a newer null never erases an older value -- and the
buckets between the first and the last one appear even when no run has them
(all nulls).  Done as ``UNION ALL`` of runs and a spine, then one
``groupBy(bucket)`` with ``max_by(col, run-if-not-null)``: no join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loadcurve.functions.timecols import as_ntz, day_start, floor_time
from loadcurve.operators.timegrid import regular_spine
from loadcurve.schemas import FORECAST
from loadcurve.session import materialize

_STEP = {"hour": 3600, "day": 86400}
_EPOCH = dt.datetime(1970, 1, 1)


def empty_forecasts(spark: SparkSession, keys=()) -> DataFrame:
    """The empty forecast table with its fixed columns, after the fields of the series keys."""
    return spark.createDataFrame([], StructType([*keys, *FORECAST.fields]))


def prediction_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_predictions")]


def upsert_forecasts(existing: DataFrame, new: DataFrame, freq: str = "hour", by=()) -> DataFrame:
    step = _STEP[freq]
    cols = prediction_columns(new)
    runs = materialize(   # forecast runs are small and read twice (bounds, values)
        existing.select(*by, "time", *cols).withColumn("_run", F.lit(0))
        .unionByName(new.select(*by, "time", *cols).withColumn("_run", F.lit(1)))
        .withColumn("_t", F.col("time"))
        .withColumn("time", floor_time("time", step)))
    bounds = runs.groupBy(*by).agg(F.min("time").alias("_lo"), F.max("time").alias("_hi"))
    spine = regular_spine(bounds, "_lo", "_hi", step, by).select(
        *by, "time", *[F.lit(None).cast("double").alias(c) for c in cols], F.lit(-1).alias("_run"))
    # order inside a bucket: run, then time (the later row of a run wins, like .last()),
    # packed in one long so the aggregation keeps fixed-width buffers (hash aggregate)
    rank = F.col("_run").cast("long") * F.lit(10 ** 12) + F.timestamp_diff("SECOND", F.lit(_EPOCH), F.col("_t"))
    order = lambda c: F.when(F.col(c).isNotNull(), rank)
    allrows = runs.unionByName(spine.withColumn("_t", F.col("time")))
    return allrows.groupBy(*by, "time").agg(*[F.max_by(c, order(c)).alias(c) for c in cols])


def clamp_hourly(forecasts: DataFrame, night_until_hour: int = 5) -> DataFrame:
    """Hours 0..5 -> 0, negatives -> 0, nulls -> 0, for every stored row."""
    return forecasts.select(*[
        F.when(F.hour("time") <= night_until_hour, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col(c))).alias(c)
        if c in prediction_columns(forecasts) else F.col(c) for c in forecasts.columns])


def actual_vs_forecast(actual: DataFrame, forecasts: DataFrame, quantity: str, start=None, by=()) -> DataFrame:
    """Actual and predicted values side by side (full outer join on time)."""
    a = actual.select(*by, "time", F.col(quantity).alias("actual"))
    f = forecasts.select(*by, "time", F.col(quantity + "_predictions").alias("predicted"))
    if start is not None:
        f = f.filter(F.col("time") >= as_ntz(start))
        a = a.filter(F.col("time") >= as_ntz(start))
    return (a.join(f, [*by, "time"], "full_outer")
             .withColumn("error", F.col("predicted") - F.col("actual")))


def forecast_scores(joined: DataFrame, by=()) -> DataFrame:
    """M9: error scores where both values exist."""
    both = joined.filter(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
    return both.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg(F.abs("error")).alias("mae"))


def peak_forecast_today(daily_forecasts: DataFrame, as_of, by=()) -> DataFrame:
    """today's row of the daily forecasts, peak power."""
    return (daily_forecasts.filter(F.col("time") == day_start(as_ntz(as_of)))
            .select(*by, "time", "peak_power_kW_predictions"))


def rolling_origins(series: DataFrame, n: int, step_hours: int = 24, by=(), time_col: str = "time") -> DataFrame:
    """Copies of a series, one for each of ``n`` origins: the rows up to ``origin``.

    Origins lie ``step_hours`` apart and before the series' end, so each has
    ``step_hours`` of later rows to be held against.  ``origin`` is a series key
    like any other, so every operator that takes keys fits all of them in one job.
    """
    by = list(by)
    if by:
        series = series.join(series.groupBy(*by).agg(F.max(time_col).alias("_last")), by)
    else:
        series = series.withColumn("_last", series.agg(F.max(time_col)).scalar())
    at = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.timestamp_add("HOUR", -i * step_hours, F.col("_last")))
    copies = series.withColumn("origin", F.explode(F.filter(at, lambda o: F.col(time_col) <= o)))
    return copies.drop("_last")


def scores_by_horizon(forecasts: DataFrame, actual: DataFrame, value_col: str = "v", by=()) -> DataFrame:
    """M9: (by..., horizon, n, rmse, mae) of forecasts with an ``origin``, ``horizon`` hours ahead of it."""
    both = forecasts.join(actual.select(*by, "time", F.col(value_col).alias("_actual")), [*by, "time"])
    error = F.col(value_col + "_predictions") - F.col("_actual")
    ahead = F.timestamp_diff("HOUR", F.col("origin"), F.col("time")).cast("int")
    return (both.select(*by, ahead.alias("horizon"), error.alias("_e")).filter("_e IS NOT NULL")
            .groupBy(*by, "horizon").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
                                         F.avg(F.abs("_e")).alias("mae")))
