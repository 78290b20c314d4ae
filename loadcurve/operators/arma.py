"""Moving-average terms of the daily model (M5, M6) by the method of Hannan and Rissanen.

The weekly difference ``w`` is first regressed on its own lags ``1..long``; the
residuals of that long autoregression stand for the unseen shocks.  Then ``w``
is regressed on its own lags (``p``, ``P`` weekly) and on the residuals' lags
(``q``, ``Q`` weekly), by the same centred sums as the plain model: one
aggregation for the long regression, one for the largest candidate; every
smaller one is a sub-matrix of it.  All candidates share one sample, so their
AIC compare.  Python solves the small systems and runs the recursion, once a
series; the residuals are columns that Spark computes.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.operators.features import tail_rows
from loadcurve.operators.seasonal import (PERIOD, _aic, _fit, _key, _with_key, design, normal_equations,
                                          regressor_lags)
from loadcurve.session import materialize


def long_residuals(series: DataFrame, long: int, value_col: str = "v", by=(), period: int = PERIOD) -> DataFrame:
    """(by..., time, v, w, e): the weekly difference and its residual from ``long`` own lags (complete rows only)."""
    by, lags = list(by), list(range(1, long + 1))
    rows = design(series, lags, value_col, by, period)
    stats = normal_equations(rows, lags, by)
    schema = T.StructType([*[stats.schema[c] for c in by], T.StructField("_beta", T.ArrayType(T.DoubleType()))])

    def solve(batches):
        for pdf in batches:
            out = pdf[by].copy()
            out["_beta"] = [_fit(row, range(long + 1))[0].tolist() for _, row in pdf.iterrows()]
            yield out

    beta = stats.mapInPandas(solve, schema)
    fit = F.col("_beta")[0]
    for i, lag in enumerate(lags, start=1):
        fit = fit + F.col("_beta")[i] * F.col(f"x{lag}")
    resid = rows.join(beta, by).select(*by, "time", F.col("y").alias("w"), (F.col("y") - fit).alias("e"))
    return resid.join(series.select(*by, "time", F.col(value_col).alias("v")), [*by, "time"])


def _names(p: int, P: int, q: int, Q: int, period: int) -> list[str]:
    return [f"w{x}" for x in regressor_lags(p, P, period)] + [f"e{x}" for x in regressor_lags(q, Q, period)]


def _stats(resid: DataFrame, names: list[str], by) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("time")
    rows = resid.select(*by, F.col("w").alias("y"), *[F.lag(n[0], int(n[1:])).over(w).alias(f"x{n}") for n in names])
    return normal_equations(rows.dropna(subset=["y", *(f"x{n}" for n in names)]), names, by)


def _prepared(series: DataFrame, value_col: str, by, long: int, period: int):
    key = _key(by)
    s = materialize(_with_key(series, by).select(*key, "time", value_col))   # read by the windows and the join
    return key, materialize(long_residuals(s, long, value_col, key, period))


def arma_scores(series: DataFrame, max_p: int = 2, max_P: int = 1, max_q: int = 1, max_Q: int = 1, long: int = 14,
                value_col: str = "v", by=(), period: int = PERIOD) -> DataFrame:
    """M6: (by..., p, q, seasonal_p, seasonal_q, aic, n) of every candidate, per series, on one sample."""
    key, resid = _prepared(series, value_col, by, long, period)
    names = _names(max_p, max_P, max_q, max_Q, period)
    stats = _stats(resid, names, key)
    out = T.StructType([*[stats.schema[c] for c in key],
                        *[T.StructField(c, T.IntegerType()) for c in ("p", "q", "seasonal_p", "seasonal_q")],
                        T.StructField("aic", T.DoubleType()), T.StructField("n", T.LongType())])

    def run(batches):
        for pdf in batches:
            rows = []
            for _, row in pdf.iterrows():
                for p, P, q, Q in itertools.product(*(range(m + 1) for m in (max_p, max_P, max_q, max_Q))):
                    idx = [0] + [1 + names.index(n) for n in _names(p, P, q, Q, period)]
                    aic = _aic(int(row["n"]), _fit(row, idx)[1], len(idx) + 1)
                    rows.append([*(row[c] for c in key), p, q, P, Q, float(aic), int(row["n"])])
            yield pd.DataFrame(rows, columns=out.fieldNames())

    scores = stats.mapInPandas(run, out)
    return scores if by else scores.drop("_series")


def arma_search(series: DataFrame, *most, by=(), **more) -> DataFrame:
    """M6: the candidate with the lowest AIC of each series (then the fewest terms)."""
    scores = arma_scores(series, *most, by=by, **more)
    terms = F.col("p") + F.col("q") + F.col("seasonal_p") + F.col("seasonal_q")
    w = Window.partitionBy(*by).orderBy("aic", terms, "p", "q", "seasonal_p")   # a row a candidate
    return scores.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk")


def arma_forecast(series: DataFrame, p: int = 1, P: int = 0, q: int = 1, Q: int = 0, long: int = 14,
                  value_col: str = "v", by=(), horizon: int = 7, period: int = PERIOD) -> DataFrame:
    """M5 with moving-average terms: ``horizon`` days ahead per series; future shocks are 0."""
    key, resid = _prepared(series, value_col, by, long, period)
    names = _names(p, P, q, Q, period)
    stats = _stats(resid, names, key)
    need = max((int(n[1:]) for n in names), default=0) + period + horizon
    hist = tail_rows(resid, need, key).select(*[F.col(c).alias("h__" + c) for c in key], F.col("time").alias("h_time"),
                                              F.col("v").alias("h_v"), F.col("e").alias("h_e"))
    out = T.StructType([*[stats.schema[c] for c in key], T.StructField("time", T.TimestampNTZType()),
                        T.StructField(value_col + "_predictions", T.DoubleType())])

    def run(st: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        if st.empty or h.empty:
            return pd.DataFrame({c: [] for c in out.fieldNames()})
        beta = _fit(st.iloc[0], range(len(names) + 1))[0]
        h = h.sort_values("h_time")
        v, e = h["h_v"].to_list(), h["h_e"].to_list()
        for _ in range(horizon):
            t = len(v)
            x = [v[t - int(n[1:])] - v[t - int(n[1:]) - period] if n[0] == "w" else e[t - int(n[1:])] for n in names]
            v.append(v[t - period] + float(beta @ np.r_[1.0, x]))
            e.append(0.0)
        last = pd.Timestamp(h["h_time"].iloc[-1])
        made = pd.DataFrame({"time": [last + pd.Timedelta(days=i) for i in range(1, horizon + 1)],
                             value_col + "_predictions": v[-horizon:]})
        for c in key:
            made[c] = st[c].iloc[0]
        return made[out.fieldNames()]

    preds = stats.groupBy(*key).cogroup(hist.groupBy(*["h__" + c for c in key])).applyInPandas(run, out)
    return preds if by else preds.drop("_series")
