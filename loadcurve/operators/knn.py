"""k-nearest-neighbour load forecast and its parameter search.

Exact brute-force kNN, distributed as *local top-k + global merge*: the
training rows of each series are hashed into blocks (about
``rows_per_block`` rows each, so long series get more tasks); the (few) query
rows of the series are replicated to every block; ``cogroup`` +
``applyInPandas`` hands one (series, block) to a task, which computes the
squared Euclidean distances with numpy and keeps only its k nearest
candidates per query.  No row per (query, training) pair is ever produced,
and no task holds more than one block of a series.  Spark then merges the
candidates: ``row_number() <= k`` per query (a ``WindowGroupLimit``) ordered
by (distance, training time) -- ties go to the earlier training row, so the
result is deterministic -- and the uniform mean of the k targets.

Depth and k may also differ by series (:func:`knn_forecast_by_params`): they
are columns of the series, and a task cuts its lags at its series' depth, so
all series of a table are forecast with their own stored parameters in one job.

The parameter search is **one** job for the whole grid.  A series is bounded
by its time span, so its plain values go to each of its tasks, and a task
builds the lags itself and answers its share of the validation rows for all
pairs: distances at the smallest depth for all training rows, chunk by chunk;
the ``max(k)`` nearest of these give, at the largest depth, a bound on every
depth's kth distance.  Distances only grow with the depth, so rows beyond the
bound at the smallest depth are out for all, and the few that are left get
exact distances at every depth.  A task returns one row per (depth, k): the
sum of squared errors and their number.  Lowest mean squared error wins; ties
go to the lower k, then the lower depth.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.operators.features import future_rows, lag_features, lag_names
from loadcurve.session import materialize

ROWS_PER_BLOCK = 2048             # training rows per task (blocks per series follow its length)
CHUNK_BYTES = 64 * 1024 * 1024     # memory of one (queries x block rows x lags) distance array


def _candidates(queries: DataFrame, train: DataFrame, by, depths: list[int], kmax: int,
                value_col: str, rows_per_block: int) -> DataFrame:
    """Per (series, query, depth): each block's ``kmax`` nearest training rows."""
    by, depths = list(by), sorted(depths)
    lags = lag_names(max(depths))
    # both sides get their own column names: with one shared lineage, Catalyst
    # would otherwise prune the second side's columns out of the cogroup
    t = train.select(*by, F.col("time").alias("t_time"), F.col(value_col).alias("t_y"),
                     *[F.col(n).alias("t_" + n) for n in lags])
    q = queries.select(*[F.col(c).alias("q__" + c) for c in by], F.col("time").alias("q_time"),
                       F.col(value_col).alias("q_y"), *[F.col(n).alias("q_" + n) for n in lags])
    # blocks per series follow its training length: one small aggregate, joined on the
    # series keys, or a scalar subquery when there is a single series
    n_blocks = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(rows_per_block))).cast("int")
    if by:
        sizes = train.groupBy(*by).agg(n_blocks.alias("_nblocks"))
        t = t.join(sizes, by)
        q = q.join(sizes.select(*[F.col(c).alias("q__" + c) for c in by], "_nblocks"), ["q__" + c for c in by])
        tb, qb = F.col("_nblocks"), F.col("_nblocks")
    else:
        tb = qb = train.agg(n_blocks.alias("_nblocks")).scalar()
    t = t.withColumn("_b", F.pmod(F.xxhash64("t_time"), tb).cast("int"))
    q = q.withColumn("_qb", F.explode(F.sequence(F.lit(0), qb - 1)))
    t = t.drop("_nblocks") if by else t
    q = q.drop("_nblocks") if by else q
    key_fields = [queries.schema[c] for c in by]
    schema = T.StructType([*key_fields,
                           T.StructField("q_time", T.TimestampNTZType()), T.StructField("q_y", T.DoubleType()),
                           T.StructField("depth", T.IntegerType()), T.StructField("t_time", T.TimestampNTZType()),
                           T.StructField("t_y", T.DoubleType()), T.StructField("d", T.DoubleType())])
    cols = schema.fieldNames()
    depth_idx = np.array(depths) - 1

    def local_topk(tdf: pd.DataFrame, qdf: pd.DataFrame) -> pd.DataFrame:
        if tdf.empty or qdf.empty:
            return pd.DataFrame({c: [] for c in cols})
        tdf = tdf.sort_values("t_time", kind="stable")
        xt = tdf[["t_" + n for n in lags]].to_numpy(float)
        yt, tt = tdf["t_y"].to_numpy(float), tdf["t_time"].to_numpy()
        keys = [tdf[c].iloc[0] for c in by]
        k = min(kmax, len(tdf))
        chunk = max(1, CHUNK_BYTES // (8 * len(tdf) * len(lags)))   # bounded memory per step
        out = []
        for lo in range(0, len(qdf), chunk):
            qc = qdf.iloc[lo:lo + chunk]
            xq = qc[["q_" + n for n in lags]].to_numpy(float)
            diff = xq[:, None, :] - xt[None, :, :]
            dist = np.cumsum(diff * diff, axis=2)[:, :, depth_idx]          # (q, t, depths)
            for di, depth in enumerate(depths):
                dd = dist[:, :, di]
                order = np.argsort(dd, axis=1, kind="stable")[:, :k]         # ties: earlier time
                qi = np.repeat(np.arange(len(qc)), k)
                ti = order.reshape(-1)
                out.append(pd.DataFrame({
                    "q_time": qc["q_time"].to_numpy()[qi], "q_y": qc["q_y"].to_numpy(float)[qi],
                    "depth": np.int32(depth), "t_time": tt[ti], "t_y": yt[ti],
                    "d": dd[qi, ti]}))
        res = pd.concat(out, ignore_index=True)
        for c, v in zip(by, keys):
            res[c] = v
        return res[cols]

    return (t.groupBy(*by, "_b").cogroup(q.groupBy(*["q__" + c for c in by], "_qb"))
             .applyInPandas(local_topk, schema))


def knn_predict(queries: DataFrame, train: DataFrame, depth: int, k: int, value_col: str = "v",
                by=(), rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Mean target of the k nearest training rows for every query row."""
    by = list(by)
    cand = _candidates(queries, train, by, [depth], k, value_col, rows_per_block)
    w = Window.partitionBy(*by, "q_time").orderBy("d", "t_time")
    near = cand.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k)
    return (near.groupBy(*by, "q_time").agg(F.avg("t_y").alias(value_col + "_predictions"))
                .withColumnRenamed("q_time", "time"))


def knn_forecast(series: DataFrame, depth: int, k: int, value_col: str = "v", by=(),
                 horizon: int = 24, rows_per_block: int = ROWS_PER_BLOCK, period: int = 24) -> DataFrame:
    """M2: forecast the ``horizon`` hours after each series' end.

    Future rows (value 0) are appended, lags are built over the extended
    series, the last ``horizon`` rows are the queries, all earlier rows with
    complete lags are the training set.
    """
    by = list(by)
    series = materialize(series.select(*by, "time", value_col))   # read by several branches
    ext = (series.withColumn("_future", F.lit(False))
           .unionByName(future_rows(series, horizon, 1, value_col, by).withColumn("_future", F.lit(True))))
    feats = lag_features(ext, depth, value_col, by, period, drop="features")
    queries = feats.filter(F.col("_future"))
    train = feats.filter(~F.col("_future") & F.col(value_col).isNotNull())
    return knn_predict(queries, train, depth, k, value_col, by, rows_per_block)


def knn_forecast_by_params(series: DataFrame, params: DataFrame, value_col: str = "v", by=("quantity",),
                           horizon: int = 24, rows_per_block: int = ROWS_PER_BLOCK, period: int = 24) -> DataFrame:
    """M2 with stored parameters: each series' forecast with its own depth and k, all series in one job.

    ``params`` has one row per series: ``by``, ``best_depth``, ``best_n_neighbors``.
    Series without parameters have no forecast.
    """
    by = list(by)
    params = params.select(*by, F.col("best_depth").cast("int"), F.col("best_n_neighbors").cast("int"))
    most = params.agg(F.max("best_depth")).first()[0] or 1
    series = materialize(series.select(*by, "time", value_col).join(params.select(*by), by, "left_semi"))
    ext = (series.withColumn("_future", F.lit(False))
           .unionByName(future_rows(series, horizon, 1, value_col, by).withColumn("_future", F.lit(True))))
    w = Window.partitionBy(*by).orderBy("time")
    lags = F.array(*[F.lag(value_col, period * k).over(w) for k in range(1, most + 1)])
    feats = (ext.withColumn("_lags", lags).join(params, by)
             .withColumn("_lags", F.slice("_lags", F.lit(1), F.col("best_depth")))
             .filter(F.forall("_lags", lambda x: x.isNotNull())))
    t = feats.filter(~F.col("_future") & F.col(value_col).isNotNull()).select(
        *by, F.col("time").alias("t_time"), F.col(value_col).alias("t_y"), F.col("_lags").alias("t_lags"),
        F.col("best_n_neighbors").alias("t_k"))
    q = feats.filter("_future").select(*[F.col(c).alias("q__" + c) for c in by], F.col("time").alias("q_time"),
                                       F.col("_lags").alias("q_lags"))
    sizes = t.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(rows_per_block))).cast("int").alias("_n"))
    t = t.join(sizes, by).withColumn("_b", F.pmod(F.xxhash64("t_time"), F.col("_n")).cast("int")).drop("_n")
    q = q.join(sizes.select(*[F.col(c).alias("q__" + c) for c in by], "_n"), ["q__" + c for c in by]).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    schema = T.StructType([*[series.schema[c] for c in by], T.StructField("q_time", T.TimestampNTZType()),
                           T.StructField("t_time", T.TimestampNTZType()), T.StructField("t_y", T.DoubleType()),
                           T.StructField("d", T.DoubleType()), T.StructField("k", T.IntegerType())])
    cols = schema.fieldNames()

    def local_topk(tdf: pd.DataFrame, qdf: pd.DataFrame) -> pd.DataFrame:
        if tdf.empty or qdf.empty:
            return pd.DataFrame({c: [] for c in cols})
        tdf = tdf.sort_values("t_time", kind="stable")
        xt, xq, k = np.stack(tdf["t_lags"]).astype(float), np.stack(qdf["q_lags"]).astype(float), int(tdf["t_k"].iloc[0])
        out = []
        for i in range(len(xq)):
            d = _distances(xq[i: i + 1], xt, xt.shape[1])[0]
            near = np.argsort(d, kind="stable")[:k]      # ties: earlier time
            out.append(pd.DataFrame({"q_time": qdf["q_time"].iloc[i], "t_time": tdf["t_time"].to_numpy()[near],
                                     "t_y": tdf["t_y"].to_numpy(float)[near], "d": d[near], "k": np.int32(k)}))
        res = pd.concat(out, ignore_index=True)
        for c in by:
            res[c] = tdf[c].iloc[0]
        return res[cols]

    cand = t.groupBy(*by, "_b").cogroup(q.groupBy(*["q__" + c for c in by], "_qb")).applyInPandas(local_topk, schema)
    rank = F.row_number().over(Window.partitionBy(*by, "q_time").orderBy("d", "t_time"))
    return (cand.withColumn("_rk", rank).filter(F.col("_rk") <= F.col("k")).groupBy(*by, F.col("q_time").alias("time"))
            .agg(F.avg("t_y").alias(value_col + "_predictions")))


QUERIES_PER_TASK = 128   # validation rows that one task answers


def _distances(xq: np.ndarray, xt: np.ndarray, depth: int) -> np.ndarray:
    """Squared distances over the first ``depth`` lags, added lag by lag."""
    d = np.zeros((len(xq), len(xt)))
    for c in range(depth):
        gap = xq[:, c, None] - xt[None, :, c]
        d += gap * gap
    return d


def _answers(xq: np.ndarray, xt: np.ndarray, yt: np.ndarray, depths: list[int], kmax: int) -> np.ndarray:
    """(depth, k) running means of the targets of one query's nearest training rows, exact at every depth."""
    least, most = depths[0], depths[-1]
    d = np.concatenate([_distances(xq, xt[a: a + CHUNK_ROWS], least)[0] for a in range(0, len(xt), CHUNK_ROWS)])
    k = min(kmax, len(xt))
    some = np.argpartition(d, k - 1)[:k]
    bound = _distances(xq, xt[some], most).max()   # no kth distance at any depth is larger
    near = np.flatnonzero(d <= bound)              # in order of time, as ties go
    gaps = (xq - xt[near])[:, :most]
    whole = np.cumsum(gaps * gaps, axis=1)
    out = np.full((len(depths), kmax), np.nan)
    for i, depth in enumerate(depths):
        first = near[np.argsort(whole[:, depth - 1], kind="stable")[:k]]
        out[i, :k] = np.cumsum(yt[first]) / np.arange(1, k + 1)
    return out


CHUNK_ROWS = 65_536   # training rows whose distances are held at once


def knn_grid_scores(series: DataFrame, depths: list[int], ks: list[int], value_col: str = "v",
                    by=(), test_size: float = 0.2, validation_size: float = 0.2,
                    queries_per_task: int = QUERIES_PER_TASK, period: int = 24) -> DataFrame:
    """Validation MSE of every (depth, k) pair, per series, in one job; lags are ``period`` rows apart.

    Rows with a null among the largest depth's lags or as target take no part;
    the last ``ceil(test_size * n)`` of the others are left out, and the last
    ``ceil(validation_size * rest)`` of the rest are answered from those before.
    """
    by, depths, ks = list(by), sorted(depths), sorted(ks)
    most, kmax = depths[-1], ks[-1]
    key = by or ["_series"]
    rows = series if by else series.withColumn("_series", F.lit(0))
    rows = materialize(rows.select(*key, "time", value_col))   # read for the sizes and the values
    share = (1 - test_size) * validation_size
    sizes = rows.groupBy(*key).agg(F.greatest(F.lit(1), F.ceil(F.count("*") * share / queries_per_task)).cast("int").alias("_n"))
    spread = rows.join(sizes, key).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    schema = T.StructType([*[rows.schema[c] for c in key], T.StructField("depth", T.IntegerType()),
                           T.StructField("k", T.IntegerType()), T.StructField("sse", T.DoubleType()),
                           T.StructField("n", T.LongType())])
    cols = schema.fieldNames()

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time", kind="stable")
        v, tasks, own = pdf[value_col].to_numpy(float), int(pdf["_n"].iloc[0]), int(pdf["_b"].iloc[0])
        at = np.arange(period * most, len(v))
        x = np.stack([v[at - period * c] for c in range(1, most + 1)], axis=1) if len(at) else np.empty((0, most))
        y = v[at]
        whole = ~(np.isnan(x).any(axis=1) | np.isnan(y))
        x, y = x[whole], y[whole]
        kept = len(y) - math.ceil(len(y) * test_size)
        train = kept - math.ceil(kept * validation_size)
        errors, n = np.zeros((len(depths), kmax)), 0
        for q in range(train + own, kept, tasks) if train > 0 else ():
            gap = _answers(x[q: q + 1], x[:train], y[:train], depths, kmax) - y[q]
            errors, n = errors + gap * gap, n + 1
        d, k = np.meshgrid(depths, ks, indexing="ij")
        out = pd.DataFrame({"depth": d.ravel().astype(np.int32), "k": k.ravel().astype(np.int32),
                            "sse": errors[:, np.array(ks) - 1].ravel(), "n": n})
        for c in key:
            out[c] = pdf[c].iloc[0]
        return out[out["n"].gt(0) & out["sse"].notna()][cols]   # pairs with more neighbours than rows have no score

    parts = spread.groupBy(*key, "_b").applyInPandas(search, schema)
    return parts.groupBy(*by, "depth", "k").agg((F.sum("sse") / F.sum("n")).alias("mse"))


def knn_grid_search(series: DataFrame, depths: list[int], ks: list[int], value_col: str = "v",
                    by=(), period: int = 24) -> DataFrame:
    """M3: best (depth, k) per series."""
    scores = knn_grid_scores(series, depths, ks, value_col, by, period=period)
    w = Window.partitionBy(*by).orderBy("mse", "k", "depth")     # depths x ks rows per series
    best = scores.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1)
    return best.select(*by, F.col("depth").cast("int").alias("best_depth"),
                       F.col("k").cast("int").alias("best_n_neighbors"), "mse")


def params_table(best: DataFrame, model: str, series_name: str, quantity: str,
                 same_as: dict[str, str] | None = None) -> DataFrame:
    """Rows of the parameter table; ``same_as`` copies a quantity's parameters."""
    base = best.select(F.lit(model).alias("model"), F.lit(series_name).alias("series"),
                       F.lit(quantity).alias("quantity"), "best_depth", "best_n_neighbors")
    for target, source in (same_as or {}).items():
        if source == quantity:
            base = base.unionByName(base.withColumn("quantity", F.lit(target)))
    return base
