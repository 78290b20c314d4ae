"""End-to-end jobs and keyed (many-series) model runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from loadcurve.operators import knn as KN
from loadcurve.operators import seasonal as SE
from loadcurve.plans import jobs
from loadcurve.session import scratch_path
from loadcurve.sources import fixtures as FX
from loadcurve.sources import tables as TB


def test_refresh_and_forecast_jobs(spark):
    root = scratch_path(spark, "jobs")
    paths = jobs.refresh(spark, FX.sessions_raw(spark, SF_SMALL), root, FX.AS_OF)
    for name in ("sessions", "sessions_subset", "chargers", "demand_5min", "demand_hourly", "demand_daily",
                 "demand_monthly", "todays_sessions", "user_profiles"):
        assert TB.table_exists(spark, name, root), name
    assert set(paths) >= {"demand_hourly", "chargers"}
    # the 5-minute table is partitioned by month; energy is preserved by the roll-ups
    d5 = TB.read_table(spark, "demand_5min", root)
    dh = TB.read_table(spark, "demand_hourly", root)
    assert abs(d5.agg(F.sum("energy_demand_kWh")).first()[0] - dh.agg(F.sum("energy_demand_kWh")).first()[0]) < 1e-6
    params = jobs.update_params(spark, root, depths=[2, 3], ks=[3, 4])
    got = {r.quantity: (r.best_depth, r.best_n_neighbors) for r in params.collect()}
    assert set(got) == {"energy_demand_kWh", "peak_power_kW", "avg_power_demand_kW"}
    assert got["avg_power_demand_kW"] == got["energy_demand_kWh"]
    hf = jobs.forecast_hourly(spark, root, 2, 3)
    assert hf.count() >= 24
    assert hf.filter((F.hour("time") <= 5) & (F.col("energy_demand_kWh_predictions") != 0)).count() == 0
    # a second run upserts: no duplicate hours
    hf2 = jobs.forecast_hourly(spark, root, 2, 3)
    assert hf2.count() == hf2.select("time").distinct().count()
    df = jobs.forecast_daily(spark, root, 1, 0)
    assert df.count() == 7


def test_forecast_jobs_keep_series_apart(spark):
    root = scratch_path(spark, "jobs-keyed")
    hs = FX.hourly_series(spark, SF_SMALL)
    table = hs.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("stationId"), "time", "v").select(
        "stationId", "time", *[(F.col("v") * F.col("stationId") * f).alias(q)
                               for f, q in enumerate(jobs.QUANTITIES, start=1)])
    TB.write_table(table, "demand_hourly", root)
    TB.write_table(table.groupBy("stationId", F.date_trunc("day", "time").cast("timestamp_ntz").alias("time")).agg(
        *[F.sum(q).alias(q) for q in jobs.QUANTITIES]), "demand_daily", root)
    for run in range(2):  # the second run merges into the stored forecasts
        hourly = jobs.forecast_hourly(spark, root, 2, 3, by=["stationId"])
        assert hourly.count() == hourly.select("stationId", "time").distinct().count() == 48
    sums = {r[0]: r[1] for r in hourly.groupBy("stationId").agg(F.sum("avg_power_demand_kW_predictions")).collect()}
    assert sums[1] > 0 and sums[2] == pytest.approx(2 * sums[1])
    daily = jobs.forecast_daily(spark, root, 1, 0, by=["stationId"])
    assert daily.count() == 14
    got = {r[0]: r[1] for r in daily.groupBy("stationId").agg(F.sum("energy_demand_kWh_predictions")).collect()}
    assert got[2] == pytest.approx(2 * got[1], rel=1e-6)


@pytest.fixture(scope="module")
def two_series(spark):
    hs = FX.hourly_series(spark, SF_SMALL).select("time", "v")
    return hs.withColumn("sid", F.lit("a")).unionByName(hs.withColumn("sid", F.lit("b")).withColumn("v", F.col("v") * 2 + 1))


def test_keyed_knn_equals_single_series(spark, two_series):
    keyed = {(r.sid, r.time): r.v_predictions for r in KN.knn_forecast(two_series, 3, 5, by=["sid"]).collect()}
    for sid in ("a", "b"):
        one = KN.knn_forecast(two_series.filter(F.col("sid") == sid).drop("sid"), 3, 5).collect()
        assert len(one) == 24
        for r in one:
            assert keyed[(sid, r.time)] == pytest.approx(r.v_predictions, rel=1e-12)


def test_keyed_grid_search_equals_single_series(spark, two_series):
    keyed = {r.sid: (r.best_depth, r.best_n_neighbors)
             for r in KN.knn_grid_search(two_series, [2, 3], [3, 4, 5], by=["sid"]).collect()}
    for sid in ("a", "b"):
        r = KN.knn_grid_search(two_series.filter(F.col("sid") == sid).drop("sid"), [2, 3], [3, 4, 5]).first()
        assert keyed[sid] == (r.best_depth, r.best_n_neighbors)


@pytest.mark.parametrize("rows_per_block", [37, 200, 100000])
@pytest.mark.parametrize("keyed", [False, True])
def test_blocks_do_not_change_the_answer(spark, two_series, rows_per_block, keyed):
    one = two_series.filter(F.col("sid") == "a")
    one = one if keyed else one.drop("sid")
    by = ["sid"] if keyed else []
    a = sorted((r.time, r.v_predictions) for r in KN.knn_forecast(one, 3, 5, by=by).collect())
    b = sorted((r.time, r.v_predictions) for r in
               KN.knn_forecast(one, 3, 5, by=by, rows_per_block=rows_per_block).collect())
    assert [t for t, _ in a] == [t for t, _ in b]
    assert np.allclose([v for _, v in a], [v for _, v in b], rtol=1e-12)


def test_keyed_seasonal_equals_single_series(spark):
    ds = FX.daily_series(spark, SF_SMALL)
    two = ds.withColumn("sid", F.lit(1)).unionByName(ds.withColumn("sid", F.lit(2)).withColumn("v", F.col("v") * 0.5))
    keyed = {(r.sid, r.time): r.v_predictions for r in SE.seasonal_forecast(two, 1, 1, by=["sid"]).collect()}
    for sid in (1, 2):
        for r in SE.seasonal_forecast(two.filter(F.col("sid") == sid).drop("sid"), 1, 1).collect():
            assert np.isclose(keyed[(sid, r.time)], r.v_predictions, rtol=1e-9)


def test_range_read_prunes_month_partitions(spark):
    from loadcurve.operators import explore as X
    from loadcurve.operators import rollup as R
    from loadcurve.plans.common import sessions
    root = scratch_path(spark, "prune")
    d5 = R.demand_5min(sessions(spark, SF_SMALL), FX.AS_OF).withColumn("ym", F.date_format("time", "yyyy-MM"))
    TB.write_table(d5, "demand_5min", root, partition_by=["ym"])
    table = TB.read_table(spark, "demand_5min", root)
    q = X.series_range(table, "demand_5min", "energy_demand_kWh", "2024-01-10", "2024-01-12")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ym" in plan and "2024-01" in plan
    assert q.columns == ["time", "energy_demand_kWh", "day"]
    assert q.count() == 2 * 288 + 1
    empty = X.series_range(table, "demand_5min", "energy_demand_kWh", "2024-03-01", None)
    assert empty.count() == 0
