"""Rules of sessions without an id, page indexes, running totals, stored parameters, sketches, backtests."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from loadcurve.operators import analytics as A
from loadcurve.operators import forecasts as FC
from loadcurve.operators import grid as G
from loadcurve.operators import knn as KN
from loadcurve.operators import kpi as K
from loadcurve.operators import today as TD
from loadcurve.operators.clean import newest_reports
from loadcurve.operators.ordered import global_running_sum, time_slice
from loadcurve.plans.common import raw, sessions
from loadcurve.session import clear_scratch, scratch_path
from loadcurve.sources import fixtures as FX
from test_incremental import frame, report


def test_sessions_without_an_id_all_count_today(spark):
    rows = [report(None, 0, 1, energy=5000.0), report(None, 0, 2, energy=7000.0), report(None, 0, 2, energy=7000.0),
            report(1, 0, 1, energy=100.0), report(1, 0, 2, energy=3000.0), report(2, -30, 1, energy=999.0)]
    as_of = dt.datetime(2024, 1, 10, 20, 0)
    r = frame(spark, rows)
    got = TD.energy_by_session_today(TD.todays_reports(r, as_of)).first()
    assert (got.energy_kWh, got.sessions) == (22.0, 4)
    card = K.kpi_today(r, as_of).first()
    assert card.kwh_today == 22.0
    assert newest_reports(r).filter("dcosId IS NULL").count() == 3


def test_clipped_slots_equal_filtered_ones(spark):
    today = TD.todays_sessions(raw(spark, SF_SMALL), FX.AS_OF)
    lo, hi = today.agg(F.min("Time"), F.max("Time")).first()
    midnight = FX.AS_OF.replace(hour=0)
    assert midnight <= lo and hi <= FX.AS_OF
    assert today.select("dcosId").distinct().count() == TD.todays_reports(raw(spark, SF_SMALL), FX.AS_OF).count()


@pytest.mark.parametrize("per_range", [7, 100, 10_000])
def test_page_index_equals_a_full_sort(spark, per_range):
    table = G.grid_table(sessions(spark, SF_SMALL))
    request = {"filterModel": {"stationId": {"type": "greaterThan", "filter": 2}},
               "sortModel": [{"colId": "vehicle_model", "sort": "desc"}, {"colId": "stationId", "sort": "asc"}]}
    index = G.PageIndex.build(table, request, rows_per_range=per_range)
    ordered = [r.dcosId for r in table.filter("stationId > 2").orderBy(*G.sort_columns(table, request["sortModel"])).collect()]
    assert index.row_count == len(ordered)
    n = len(ordered)
    for start, end in ((0, 5), (n // 2, n // 2 + 20), (n - 3, None), (n - 3, n + 50), (n + 1, n + 9), (0, None)):
        page = index.page(start, end).orderBy("_position")
        assert [r.dcosId for r in page.collect()] == ordered[start:end]
    rest = G.grid_query(table, request | {"startRow": n - 40})
    assert [r.dcosId for r in rest.rows.collect()] == ordered[n - 40:] and rest.row_count.first().rowCount == n
    none = G.PageIndex.build(table.limit(0), request)
    assert none.row_count == 0 and none.page(0, 10).count() == 0


def test_text_conditions_literal_and_or(spark):
    df = spark.createDataFrame([(1, "a.b"), (2, "axb"), (3, None), (4, "zz")], "dcosId long, t string").withColumn(
        "connectTime", F.lit(dt.datetime(2024, 1, 1)))
    ids = lambda cond: sorted(r.dcosId for r in G.apply_filters(df, {"t": cond}).collect())
    assert ids({"type": "contains", "filter": "a.b"}) == [1, 2]
    assert ids({"type": "contains", "filter": "a.b", "literal": True}) == [1]
    assert ids({"type": "notContains", "filter": "a.b", "literal": True}) == [2, 3, 4]
    one, two = {"type": "equals", "filter": "zz"}, {"type": "startsWith", "filter": "ax"}
    assert ids({"operator": "OR", "condition1": one, "condition2": two}) == [2, 4]
    assert ids({"type": "notStartsWith", "filter": "a"}) == [3, 4]
    assert ids({"type": "endsWith", "filter": "b"}) == [1, 2]


@pytest.mark.parametrize("seconds", [60, 3600, 86400 * 400])
def test_running_sum_by_slices_equals_a_window(spark, seconds):
    t0 = dt.datetime(2023, 12, 31, 23, 0)
    rows = [(k, None if k % 17 == 0 else t0 + dt.timedelta(minutes=(k * 37) % 5000), float((k * 7) % 11 - 5)) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, t timestamp_ntz, v double")
    got = global_running_sum(df, [F.col("t"), F.col("id")], F.col("v"), "run", time_slice("t", seconds))
    w = Window.orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: r.run for r in df.withColumn("run", F.sum("v").over(w)).collect()}
    assert {r.id: r.run for r in got.collect()} == pytest.approx(want)


def test_running_totals_between_dates_read_the_sessions_once(spark):
    s = sessions(spark, SF_SMALL)
    part = A.cumulative_energy(s, "2024-01-05", "2024-01-10").collect()
    assert part and all(dt.datetime(2024, 1, 5) <= r.finishChargeTime <= dt.datetime(2024, 1, 10) for r in part)
    kwh = s.filter("finishChargeTime BETWEEN '2024-01-05' AND '2024-01-10'").agg(F.sum("cumEnergy_Wh")).first()[0] / 1000
    assert max(r.cum_energy_kWh for r in part if r.cum_energy_kWh) == pytest.approx(kwh)
    users = A.cumulative_users(s, "2024-01-05", "2024-01-10")
    rows = users.collect()
    last = max(rows, key=lambda r: r.cumulative_users)
    assert last.cumulative_users == s.filter(F.col("startChargeTime") <= F.lit("2024-01-10").cast("timestamp_ntz")).agg(
        F.countDistinct("userId")).first()[0]
    spark.catalog.clearCache()                        # of other tests
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:                                              # the plan as a whole, before anything has run
        plan = A.cumulative_users(s)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_forecasts_by_stored_parameters_equal_single_ones(spark):
    hs = FX.hourly_series(spark, SF_SMALL).select("time", "v")
    two = hs.withColumn("quantity", F.lit("a")).unionByName(hs.withColumn("quantity", F.lit("b")).withColumn("v", F.col("v") * 3))
    params = spark.createDataFrame([("a", 2, 7), ("b", 5, 3), ("c", 9, 1)], "quantity string, best_depth int, best_n_neighbors int")
    got = {(r.quantity, r.time): r.v_predictions for r in KN.knn_forecast_by_params(two, params, rows_per_block=100).collect()}
    assert len(got) == 48
    for q, depth, k in (("a", 2, 7), ("b", 5, 3)):
        for r in KN.knn_forecast(two.filter(F.col("quantity") == q).drop("quantity"), depth, k).collect():
            assert got[q, r.time] == pytest.approx(r.v_predictions)


@pytest.mark.parametrize("queries", [1, 10, 10_000])
def test_search_tasks_do_not_change_the_scores(spark, queries):
    hs = FX.hourly_series(spark, SF_SMALL).select("time", "v").withColumn("v", F.when(F.col("time") > "2024-01-02", F.col("v")))
    got = {(r.depth, r.k): r.mse for r in KN.knn_grid_scores(hs, [3, 5, 6], [1, 4], period=2, queries_per_task=queries).collect()}
    whole = {(r.depth, r.k): r.mse for r in KN.knn_grid_scores(hs, [3, 5, 6], [1, 4], period=2).collect()}
    assert got == pytest.approx(whole) and len(got) == 6


def test_backtest_by_horizon(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(h % 24)) for h in range(24 * 20)]
    series = spark.createDataFrame(rows, "time timestamp_ntz, v double")
    preds = KN.knn_forecast(FC.rolling_origins(series, 3), 2, 2, by=["origin"])
    scores = FC.scores_by_horizon(preds, series).collect()
    assert sorted(r.horizon for r in scores) == list(range(1, 25)) and {r.n for r in scores} == {3}
    assert all(r.rmse == 0 and r.mae == 0 for r in scores)       # a plain daily cycle
    wrong = FC.scores_by_horizon(preds.withColumn("v_predictions", F.col("v_predictions") + 2), series).collect()
    assert {round(r.rmse, 9) for r in wrong} == {2.0} == {round(r.mae, 9) for r in wrong}


def test_user_sketches_merge_over_any_range(spark):
    days = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=k % 30), f"u{(k * k) % 4001}", k % 2) for k in range(20_000)]
    s = spark.createDataFrame(days, "connectTime timestamp_ntz, userId string, siteId int")
    sketches = K.daily_user_sketches(s, ["siteId"])
    for start, end in (("2024-01-01", "2024-01-30"), ("2024-01-03", "2024-01-04"), (None, "2024-01-10")):
        days_in = s.filter((F.to_date("connectTime") >= F.lit(start or "2024-01-01").cast("date")) & (F.to_date("connectTime") <= F.lit(end).cast("date")))
        exact = {r.siteId: r.n for r in days_in.groupBy("siteId").agg(F.countDistinct("userId").alias("n")).collect()}
        got = {r.siteId: r.users for r in K.users_between(sketches, start, end, ["siteId"]).collect()}
        assert set(got) == set(exact) and all(abs(got[k] - exact[k]) <= 0.05 * exact[k] for k in exact)
    assert sketches.filter("day = '2024-01-03'").agg(F.sum("users")).first()[0] == s.filter(
        F.to_date("connectTime") == "2024-01-03").select("siteId", "userId").distinct().count()


def test_scratch_folders_go_together(spark):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    other = scratch_path(spark, "gone")
    assert path.rsplit("/", 1)[0] == other.rsplit("/", 1)[0] and path != other
    assert clear_scratch.__doc__ and spark.read.parquet(path).count() == 3


def test_change_texts(spark):
    today = spark.createDataFrame([(1234.56, 3, 0.0, -2), (0.0, 0, -12.5, 0), (1.0, 1200, 100.4, 7)],
                                  "kwh_today double, sessions_today long, kwh_change_pct double, users_change long")
    peak = spark.createDataFrame([(25.25, None)], "peak_power_kW double, change_pct double")
    got = [tuple(r) for r in K.today_card_text(today, peak).collect()]
    assert sorted(got) == sorted([
        ("1,234.6 kWh", "3", "No change since yesterday!", "-2 users since yesterday!", "25.2 kW", "No change since last month!"),
        ("0.0 kWh", "0", "-12% since yesterday!", "No change since yesterday!", "25.2 kW", "No change since last month!"),
        ("1.0 kWh", "1,200", "+100% since yesterday!", "+7 users since yesterday!", "25.2 kW", "No change since last month!")])


def test_text_dates_with_offsets_and_rejects(spark):
    from loadcurve.sources import tables as TB
    texts = ["2024-01-10T08:00:00Z", "2024-01-10T10:00:00+02:00", "2024-01-10T08:00:00.000Z", "2024-01-10 08:00:00",
             "01/10/2024 08:00:00", "no date", "", None]
    rows = [(str(k) if k != 1 else "x1", t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "dcosId string, connectTime string")
    got = [r.connectTime for r in TB.parse_texts(df).orderBy(F.col("connectTime").asc_nulls_last()).collect()]
    assert got == [dt.datetime(2024, 1, 10, 8, 0)] * 5 + [None] * 3
    assert TB.text_rejects(df).first().asDict() == {"connectTime": 1, "dcosId": 1}


def test_months_of_a_longer_span(spark):
    from loadcurve.operators import clean as C
    from loadcurve.operators import rollup as R
    as_of = dt.datetime(2024, 4, 2, 0, 0)
    s = C.clean_sessions(frame(spark, [report(1, 0, 1), report(2, 24 * 30, 2), report(3, 24 * 55, 3), report(4, 24 * 55, 1)]))
    d5 = R.demand_5min(s, as_of)
    months = {r.time: r for r in R.rollup(d5, "month").collect()}
    assert sorted(months) == [dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 31), dt.datetime(2024, 4, 30)]
    assert [months[t].month for t in sorted(months)] == ["January", "February", "March", "April"]
    rows = d5.collect()
    for t, m in months.items():
        own = [r for r in rows if (r.time.year, r.time.month) == (t.year, t.month)]
        assert m.energy_demand_kWh == pytest.approx(sum(r.energy_demand_kWh for r in own))
        assert m.avg_power_demand_kW == pytest.approx(sum(r.avg_power_demand_kW for r in own) / len(own))
        assert m.peak_power_kW == max(r.peak_power_kW for r in own)
    peak = K.kpi_month_peak(R.rollup(d5, "month")).first()
    assert peak.time == dt.datetime(2024, 4, 30) and peak.previous_peak_power_kW == months[dt.datetime(2024, 3, 31)].peak_power_kW


def test_newest_reports_of_stations_over_batches(spark, monkeypatch):
    from loadcurve.schemas import SESSIONS_RAW
    from loadcurve.operators import clean as C
    from loadcurve.streaming import charger_state as SCS
    from test_incremental import stage
    monkeypatch.setattr(SCS, "FOLDED", 2)
    batches = [[report(1, 5, 1), report(2, 5, 1)], [report(3, 1, 1)], [report(4, 6, 1)], [report(5, 2, 2)], [report(6, 3, 1)]]
    for k, rows in enumerate(batches):
        rows[0]["stationId"] = 1 + k % 2
    path = SCS.run_newest_reports(spark, C.clean_sessions(stage(spark, batches).select(*SESSIONS_RAW.fieldNames())))
    got = {r.stationId: (r.dcosId, r.state) for r in SCS.newest_state(spark, path).collect()}
    assert got == {1: (4, "IN USE"), 2: (5, "IDLE")}
