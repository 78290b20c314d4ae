"""Seasonal daily model (M5, M6, W8) -- re-aimed from SARIMA maximum likelihood.

Model: weekly difference ``w_t = v_t - v_{t-7}`` (D=1, m=7), regressed on its
own lags ``1..p`` and seasonal lags ``7, 14, .., 7P`` with an intercept,
fitted by ordinary least squares.  The moving-average terms and the
likelihood solver of the reference's libraries are not reproduced, so its
digits are not matched; the order search compares AIC on a common sample.

Plan: the centred normal equations (means, co-moments and n) of the largest
candidate come from **one** ``groupBy(series).agg`` of covariances --
partial-aggregated, whatever the series length.  Every candidate
is a sub-matrix of them.  Python only solves the tiny systems and runs the
7-step recursion, once per series (``mapInPandas`` over one row per series).
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.operators.features import tail_rows
from loadcurve.session import materialize

PERIOD = 7


def regressor_lags(p: int, P: int, period: int = PERIOD) -> list[int]:
    return list(range(1, p + 1)) + [period * i for i in range(1, P + 1)]


def design(series: DataFrame, lags: list[int], value_col: str = "v", by=(), period: int = PERIOD) -> DataFrame:
    """Rows with the differenced target ``y`` and regressors ``x<L>`` (complete rows only)."""
    w = Window.partitionBy(*by).orderBy("time")
    d = series.withColumn("_w", F.col(value_col) - F.lag(value_col, period).over(w))
    d = d.select(*by, "time", F.col("_w").alias("y"), *[F.lag("_w", L).over(w).alias(f"x{L}") for L in lags])
    return d.dropna(subset=["y"] + [f"x{L}" for L in lags])


def normal_equations(des: DataFrame, lags: list[int], by=()) -> DataFrame:
    """One aggregation: n, means, and sums of products about the means (``xx_i_j``, ``xy_i``, ``yy``).

    ``covar_pop`` keeps its running sums about the running means, so large
    levels cancel nothing; the intercept is recovered from the means.
    """
    n, y = F.count("*"), F.col("y")
    xs = [F.col(f"x{L}") for L in lags]
    aggs = [n.alias("n"), F.avg(y).alias("m_y"), (F.var_pop(y) * n).alias("yy")]
    for i, x in enumerate(xs, start=1):
        aggs += [F.avg(x).alias(f"m_{i}"), (F.covar_pop(x, y) * n).alias(f"xy_{i}")]
        aggs += [(F.covar_pop(x, xs[j - 1]) * n).alias(f"xx_{i}_{j}") for j in range(i, len(xs) + 1)]
    return des.groupBy(*by).agg(*aggs)


def _fit(row, idx):
    """(intercept and slopes, rss) of the regressors at the positions ``idx`` (0 = intercept, always in)."""
    own = [i for i in idx if i]
    if not own:
        return np.array([row["m_y"]]), max(float(row["yy"]), 0.0)
    xtx = np.array([[row[f"xx_{min(i, j)}_{max(i, j)}"] for j in own] for i in own], dtype=float)
    xty = np.array([row[f"xy_{i}"] for i in own], dtype=float)
    scale = np.sqrt(np.diag(xtx))
    scale[scale == 0] = 1.0
    slopes = np.linalg.lstsq(xtx / np.outer(scale, scale), xty / scale, rcond=None)[0] / scale
    intercept = row["m_y"] - sum(row[f"m_{i}"] * b for i, b in zip(own, slopes, strict=True))
    rss = float(row["yy"] - 2 * slopes @ xty + slopes @ xtx @ slopes)
    return np.r_[intercept, slopes], max(rss, 0.0)


def _aic(n: int, rss: float, n_params: int) -> float:
    if n <= 0:
        return float("inf")
    return n * np.log(max(rss, 1e-300) / n) + 2 * n_params


def _forecast(hist: np.ndarray, beta: np.ndarray, lags: list[int], horizon: int, period: int) -> np.ndarray:
    v = list(hist)
    for _ in range(horizon):
        n = len(v)
        w = lambda t: v[t] - v[t - period]  # noqa: E731  (w at position t)
        x = [1.0] + [w(n - L) for L in lags]
        v.append(v[n - period] + float(np.dot(beta, x)))
    return np.array(v[len(hist):])


def _key(by):
    return list(by) if by else ["_series"]


def _with_key(df: DataFrame, by) -> DataFrame:
    return df if by else df.withColumn("_series", F.lit(0))


def seasonal_forecast(series: DataFrame, p: int = 1, P: int = 0, value_col: str = "v", by=(),
                      horizon: int = 7, period: int = PERIOD) -> DataFrame:
    """M5: ``horizon`` days ahead per series with a fixed order (p, P)."""
    key = _key(by)
    s = materialize(_with_key(series, by).select(*key, "time", value_col))   # read by two branches
    orders = s.select(*key).distinct().withColumns({"ar_order": F.lit(p), "seasonal_ar_order": F.lit(P)})
    out = _forecast_orders(s, orders, p, P, value_col, key, horizon, period)
    return out if by else out.drop("_series")


def seasonal_forecast_by_params(series: DataFrame, params: DataFrame, value_col: str = "v", by=("quantity",),
                                horizon: int = 7, period: int = PERIOD) -> DataFrame:
    """M5 with stored orders: each series with its own (``ar_order``, ``seasonal_ar_order``), all in one job.

    All are fitted on the rows that have the largest order's lags, as the search
    compares them.  Series without stored orders have no forecast.
    """
    params = params.select(*by, "ar_order", "seasonal_ar_order")
    most = params.agg(F.max("ar_order"), F.max("seasonal_ar_order")).first()
    s = materialize(series.select(*by, "time", value_col).join(params.select(*by), list(by), "left_semi"))
    return _forecast_orders(s, params, most[0] or 0, most[1] or 0, value_col, list(by), horizon, period)


def _forecast_orders(s: DataFrame, orders: DataFrame, p: int, P: int, value_col: str, key: list[str],
                     horizon: int, period: int) -> DataFrame:
    """Forecasts of each series with its row of ``orders``; ``p`` and ``P`` are the largest among them.

    The per-series statistics (one row) and the series' last days (a
    ``WindowGroupLimit``-bounded tail) meet in a ``cogroup`` -- a grouping,
    not a join -- and one small Python function solves and recurses.
    """
    lags = regressor_lags(p, P, period)
    stats = normal_equations(design(s, lags, value_col, key, period), lags, key).join(orders, key)
    need = max(lags, default=0) + period + horizon
    # own column names on the second side (shared lineage would be pruned away)
    hist = tail_rows(s.select(*key, "time", value_col), need, key).select(
        *[F.col(c).alias("h__" + c) for c in key], F.col("time").alias("h_time"), F.col(value_col).alias("h_v"))
    out_schema = T.StructType([*[stats.schema[c] for c in key],
                               T.StructField("time", T.TimestampNTZType()),
                               T.StructField(value_col + "_predictions", T.DoubleType())])
    cols = out_schema.fieldNames()

    def run(st: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        if st.empty or h.empty:
            return pd.DataFrame({c: [] for c in cols})
        row = st.iloc[0]
        own = regressor_lags(int(row["ar_order"]), int(row["seasonal_ar_order"]), period)
        beta, _ = _fit(row, [0] + [1 + lags.index(L) for L in own])
        h = h.sort_values("h_time")
        pred = _forecast(h["h_v"].to_numpy(float), beta, own, horizon, period)
        last = pd.Timestamp(h["h_time"].iloc[-1])
        out = pd.DataFrame({"time": [last + pd.Timedelta(days=i) for i in range(1, horizon + 1)],
                            value_col + "_predictions": pred})
        for c in key:
            out[c] = row[c]
        return out[cols]

    return stats.groupBy(*key).cogroup(hist.groupBy(*["h__" + c for c in key])).applyInPandas(run, out_schema)


def seasonal_order_search(series: DataFrame, max_p: int = 2, max_P: int = 2, value_col: str = "v",
                          by=(), train_share: float = 0.8, period: int = PERIOD) -> DataFrame:
    """M6: order (p, P) with the lowest AIC, on the first ``train_share`` of each series."""
    key = _key(by)
    s = _with_key(series, by)
    w = Window.partitionBy(*key).orderBy("time")
    n_all = F.count(F.lit(1)).over(Window.partitionBy(*key))
    train = (s.withColumn("_rn", F.row_number().over(w)).withColumn("_n", n_all)
              .filter(F.col("_rn") <= F.col("_n") - F.ceil(F.col("_n") * (1 - train_share)))
              .drop("_rn", "_n"))
    lags = regressor_lags(max_p, max_P, period)
    stats = normal_equations(design(train, lags, value_col, key, period), lags, key)
    out_schema = T.StructType([*[stats.schema[c] for c in key],
                               T.StructField("ar_order", T.IntegerType()), T.StructField("seasonal_ar_order", T.IntegerType()),
                               T.StructField("aic", T.DoubleType()), T.StructField("n", T.LongType())])

    def run(batches):
        for pdf in batches:
            rows = []
            for _, row in pdf.iterrows():
                best = None
                for p, P in itertools.product(range(max_p + 1), range(max_P + 1)):
                    idx = [0] + [1 + lags.index(L) for L in regressor_lags(p, P, period)]
                    _, rss = _fit(row, idx)
                    aic = _aic(int(row["n"]), rss, len(idx) + 1)
                    cand = (aic, p + P, p, P)
                    if best is None or cand < best:
                        best = cand
                rows.append([*(row[c] for c in key), best[2], best[3], float(best[0]), int(row["n"])])
            yield pd.DataFrame(rows, columns=out_schema.fieldNames())

    out = stats.mapInPandas(run, out_schema)
    return out if by else out.drop("_series")
