"""kNN and the seasonal model against numpy brute force."""

import numpy as np
import pandas as pd
import pytest

from conftest import SF_SMALL
from loadcurve.operators import knn as KN
from loadcurve.operators import seasonal as SE
from loadcurve.sources import fixtures as FX


def _lags(v, depth):
    n = len(v)
    X = np.full((n, depth), np.nan)
    for k in range(1, depth + 1):
        X[24 * k:, k - 1] = v[:n - 24 * k]
    return X


def _knn(Xtr, ytr, ttr, Xq, k):
    out = []
    for x in Xq:
        d = ((Xtr - x) ** 2).sum(axis=1)
        idx = np.lexsort((ttr, d))[:k]
        out.append(ytr[idx].mean())
    return np.array(out)


@pytest.fixture(scope="module")
def hourly(spark):
    return FX.hourly_series(spark, SF_SMALL).select("time", "v").toPandas().sort_values("time")


def test_knn_forecast_equals_numpy(spark, hourly):
    depth, k = 4, 7
    v = np.concatenate([hourly.v.to_numpy(), np.zeros(24)])
    X = _lags(v, depth)
    ok = ~np.isnan(X).any(axis=1)
    n = len(hourly)
    t = np.arange(len(v))
    tr = ok & (t < n)
    want = _knn(X[tr], v[tr], t[tr], X[n:], k)
    got = KN.knn_forecast(spark.createDataFrame(hourly), depth, k).toPandas().sort_values("time").v_predictions
    assert np.allclose(got.to_numpy(), want, rtol=1e-9, atol=1e-9)


def test_grid_scores_equal_numpy(spark, hourly):
    depths, ks = [2, 3], [3, 5]
    v = hourly.v.to_numpy()
    X = _lags(v, max(depths))
    ok = ~np.isnan(X).any(axis=1)
    Xo, yo, to = X[ok], v[ok], np.arange(len(v))[ok]
    n = len(yo)
    test = int(np.ceil(0.2 * n)); tv = n - test; val = int(np.ceil(0.2 * tv)); tr = tv - val
    got = {(r.depth, r.k): r.mse for r in
           KN.knn_grid_scores(spark.createDataFrame(hourly), depths, ks).collect()}
    for d in depths:
        for k in ks:
            pred = _knn(Xo[:tr, :d], yo[:tr], to[:tr], Xo[tr:tv, :d], k)
            assert got[(d, k)] == pytest.approx(((pred - yo[tr:tv]) ** 2).mean(), rel=1e-9)


def test_seasonal_fit_equals_lstsq(spark):
    rng = np.random.default_rng(7)
    n = 200
    v = 100 + 10 * np.sin(np.arange(n) * 2 * np.pi / 7) + rng.normal(0, 1, n).cumsum()
    pdf = pd.DataFrame({"time": pd.date_range("2020-01-01", periods=n, freq="D"), "v": v})
    p, P = 2, 1
    lags = SE.regressor_lags(p, P)
    w = v[7:] - v[:-7]
    rows = [(w[t], [1.0] + [w[t - L] for L in lags]) for t in range(max(lags), len(w))]
    y = np.array([r[0] for r in rows]); X = np.array([r[1] for r in rows])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    hist = list(v)
    for _ in range(7):
        m = len(hist)
        x = [1.0] + [hist[m - L] - hist[m - L - 7] for L in lags]
        hist.append(hist[m - 7] + float(np.dot(beta, x)))
    got = SE.seasonal_forecast(spark.createDataFrame(pdf), p, P).toPandas().sort_values("time")
    assert np.allclose(got.v_predictions.to_numpy(), np.array(hist[n:]), rtol=1e-8)


def test_order_search_prefers_true_seasonal_model(spark):
    rng = np.random.default_rng(3)
    n = 400
    w = np.zeros(n)
    e = rng.normal(0, 1, n)
    for t in range(14, n):
        w[t] = 0.7 * w[t - 7] + e[t]
    v = np.cumsum(np.zeros(n))
    v = np.zeros(n)
    for t in range(n):
        v[t] = (v[t - 7] if t >= 7 else 50.0) + w[t]
    pdf = pd.DataFrame({"time": pd.date_range("2020-01-01", periods=n, freq="D"), "v": v})
    r = SE.seasonal_order_search(spark.createDataFrame(pdf), 2, 2).first()
    assert r.seasonal_ar_order >= 1


def test_seasonal_fit_keeps_its_intercept_at_large_values(spark):
    """Differences near 1e9: the same intercept and slope as a direct fit on centred values."""
    import datetime as dt

    import numpy as np
    from loadcurve.operators import seasonal as SE
    rng = np.random.default_rng(3)
    w = [1e9]
    for _ in range(299):
        w.append(5e8 + 0.5 * w[-1] + float(rng.normal(0, 1e5)))
    v = [0.0] * 7
    for x in w:
        v.append(v[-7] + x)
    t0 = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([(t0 + dt.timedelta(days=i), x) for i, x in enumerate(v)], "time timestamp_ntz, v double")
    row = SE.normal_equations(SE.design(s, [1]), [1]).first()
    beta, _ = SE._fit(row, [0, 1])
    y, x = np.array(w[1:]), np.array(w[:-1])
    slope = ((x - x.mean()) @ (y - y.mean())) / ((x - x.mean()) @ (x - x.mean()))
    assert abs(beta[1] - slope) < 1e-6
    assert abs(beta[0] - (y.mean() - slope * x.mean())) < 1e3


def _daily(spark, v, sid=None):
    import datetime as dt
    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(x)) + ((sid,) if sid is not None else ()) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "time timestamp_ntz, v double" + (", sid int" if sid is not None else ""))


def _weekly(shocks, theta, phi):
    """A series whose weekly difference is an ARMA(1, 1) of the shocks."""
    w = np.zeros(len(shocks))
    for t in range(1, len(shocks)):
        w[t] = phi * w[t - 1] + shocks[t] + theta * shocks[t - 1]
    v = list(range(100, 107))
    for t in range(len(w)):
        v.append(v[-7] + w[t])
    return np.array(v)


def test_arma_forecast_equals_numpy(spark):
    from loadcurve.operators import arma
    v, long = _weekly(np.random.default_rng(3).normal(size=300), 0.6, 0.3), 7
    w = v[7:] - v[:-7]
    x = np.column_stack([np.ones(len(w) - long), *[w[long - k: -k] for k in range(1, long + 1)]])
    e = w[long:] - x @ np.linalg.lstsq(x, w[long:], rcond=None)[0]
    y = w[long:]
    x = np.column_stack([np.ones(len(y) - 1), y[:-1], e[:-1]])
    beta = np.linalg.lstsq(x, y[1:], rcond=None)[0]
    want, shock, last = list(v), e[-1], w[-1]
    for _ in range(7):
        last, shock = beta @ [1, last, shock], 0.0
        want.append(want[-7] + last)
    got = [r.v_predictions for r in arma.arma_forecast(_daily(spark, v), 1, 0, 1, 0, long).orderBy("time").collect()]
    assert np.allclose(got, want[-7:], rtol=1e-6)


def test_arma_search_finds_the_moving_average_by_series(spark):
    from loadcurve.operators import arma
    shocks = np.random.default_rng(5).normal(size=900)
    two = _daily(spark, _weekly(shocks, 0.9, 0.0), 1).unionByName(_daily(spark, _weekly(shocks, 0.0, 0.8), 2))
    best = {r.sid: r for r in arma.arma_search(two, 1, 0, 1, 0, by=["sid"]).collect()}
    assert best[1].q == 1 and best[2].p == 1
    alone = {r.p: r.aic for r in arma.arma_scores(two.filter("sid = 1").drop("sid"), 1, 0, 0, 0).collect()}
    assert min(alone.values()) > best[1].aic      # without the term it is worse
