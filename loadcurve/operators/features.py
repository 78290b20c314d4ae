"""Series features for the hourly model.

Windows are partitioned by the series keys: one series is bounded by its time
span (hours), not by the data volume, and many series run in parallel.  All
lags share one window spec, so Spark sorts each series once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lag_names(depth: int) -> list[str]:
    return [f"lag{k}" for k in range(1, depth + 1)]


def lag_features(series: DataFrame, depth: int, value_col: str = "v", by=(), period: int = 24,
                 time_col: str = "time", drop: str = "all") -> DataFrame:
    """``lag k`` = the value ``period*k`` rows earlier, k = 1..depth.

    ``drop="all"`` removes rows with any null (W3, training); ``drop="features"``
    only rows with a null lag, so unknown targets stay (W4, prediction).
    """
    w = Window.partitionBy(*by).orderBy(time_col)
    out = series.select("*", *[F.lag(value_col, period * k).over(w).alias(n)
                               for k, n in enumerate(lag_names(depth), start=1)])
    subset = lag_names(depth) + ([value_col] if drop == "all" else [])
    return out.dropna(subset=subset)


def lag_columns(df: DataFrame) -> DataFrame:
    """P25: the lag columns, selected by name pattern."""
    return df.select(df.colRegex("`lag[0-9]+`"))


def subset_lags(df: DataFrame, num_lags: int, keep=()) -> DataFrame:
    """The first ``num_lags`` lag columns."""
    lags = sorted(lag_columns(df).columns, key=lambda c: int(c[3:]))
    return df.select(*keep, *[c for c in lags if int(c[3:]) <= num_lags])


def chrono_split(df: DataFrame, by=(), time_col: str = "time", test_size: float = 0.2,
                 validation_size: float | None = 0.2) -> DataFrame:
    """Last ``ceil(test_size*n)`` rows -> test; of the rest, last share -> validation."""
    w = Window.partitionBy(*by).orderBy(time_col)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rn = F.row_number().over(w)
    out = df.withColumn("_rn", rn).withColumn("_n", n)
    n_test = F.ceil(F.col("_n") * test_size)
    n_tv = F.col("_n") - n_test
    split = F.when(F.col("_rn") > n_tv, "test")
    if validation_size:
        split = split.when(F.col("_rn") > n_tv - F.ceil(n_tv * validation_size), "validation")
    return out.withColumn("split", split.otherwise("train")).drop("_rn", "_n")


def tail_rows(df: DataFrame, n: int, by=(), time_col: str = "time") -> DataFrame:
    """The last ``n`` rows of each series (``WindowGroupLimit`` keeps only n per task)."""
    w = Window.partitionBy(*by).orderBy(F.col(time_col).desc())
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n).drop("_rk")


def future_rows(series: DataFrame, horizon: int = 24, step_hours: int = 1, value_col: str = "v",
                by=(), time_col: str = "time") -> DataFrame:
    """M1: ``horizon`` rows after each series' last time, value 0."""
    last = series.groupBy(*by).agg(F.max(time_col).alias("_last"))
    return last.select(*by, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_k"), "_last").select(
        *by, F.timestamp_add("HOUR", F.col("_k") * step_hours, F.col("_last")).alias(time_col),
        F.lit(0.0).alias(value_col))
