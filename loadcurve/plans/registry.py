"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` and their oracle SQL.

Every query reads the driver's tables (through the fixture derivations) and
runs over them whole.  ``ORACLE`` holds the DuckDB SQL for the names that SQL
can express; the rest are checked by row count and unit tests.
"""

from __future__ import annotations

import datetime as dt
import functools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.operators import analytics as A
from loadcurve.operators import arma as ARMA
from loadcurve.operators import clean as C
from loadcurve.operators import explore as X
from loadcurve.operators import features as FE
from loadcurve.operators import forecasts as FC
from loadcurve.operators import grid as G
from loadcurve.operators import knn as KN
from loadcurve.operators import kpi as K
from loadcurve.operators import rollup as R
from loadcurve.operators import seasonal as SE
from loadcurve.operators import status as ST
from loadcurve.operators import today as TD
from loadcurve.operators.timegrid import regular_spine
from loadcurve.functions.timecols import as_ntz
from loadcurve.plans import incremental as INC
from loadcurve.plans import oracle as O
from loadcurve.plans.common import raw, rounded, sessions
from loadcurve.plans import jobs as JOBS
from loadcurve.plans.jobs import KNN_DEPTHS, KNN_KS
from loadcurve.session import ensure_defaults, scratch_path
from loadcurve.sources import fixtures as FX
from loadcurve.sources import tables as TB
from loadcurve.sources.fixtures import AS_OF
from loadcurve.streaming import charger_state as SCS
from loadcurve.streaming import demand as SD
from loadcurve.streaming import load_changes as LC
from loadcurve.streaming import upsert as SU
from loadcurve.streaming.sources import file_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_defaults(spark)          # UTC wall clock, checkpoint folder
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---- step 1: scan, clean, slots, 5-minute demand, hourly ---------------------------

@register("scan_sessions", O.rounded(O.with_ctes(O.SESSIONS_RAW) + " SELECT * FROM sessions_raw",
                                     ["DurationHrs", "cumEnergy_Wh", "peakPower_W"]))
def q_scan_sessions(spark, sf_dir):
    """Every raw session, written as a table and scanned with the declared schema."""
    path = scratch_path(spark, "raw-sessions")
    raw(spark, sf_dir).write.parquet(path)
    return rounded(TB.scan_sessions(spark, path))


@register("clean_sessions", O.rounded(O.with_ctes(*O.BASE) + " SELECT * FROM sessions", O.SESSION_DOUBLES))
def q_clean_sessions(spark, sf_dir):
    return rounded(sessions(spark, sf_dir))


@register("session_subset", O.rounded(
    O.with_ctes(*O.BASE) + " SELECT connectTime, userId, cumEnergy_Wh, DurationHrs, choice FROM sessions",
    ["cumEnergy_Wh", "DurationHrs"]))
def q_session_subset(spark, sf_dir):
    return rounded(C.session_subset(sessions(spark, sf_dir)))


@register("session_slots", O.rounded(O.with_ctes(*O.BASE) + f"""
  SELECT dcosId, slot, {O.slot_ts('slot')} AS time, power_W FROM (
    SELECT dcosId, unnest(generate_series({O.LO}, {O.HI})) AS slot, true_peakPower_W AS power_W
    FROM sessions WHERE {O.LO} <= {O.HI})""", ["power_W"]))
def q_session_slots(spark, sf_dir):
    return rounded(R.slot_power(sessions(spark, sf_dir)).select("dcosId", "slot", "time", "power_W"))


@register("demand_5min", O.rounded(O.with_ctes(*O.BASE, O.DEMAND_5MIN) + " SELECT * FROM demand_5min",
                                   O.DEMAND_DOUBLES))
def q_demand_5min(spark, sf_dir):
    return rounded(R.demand_5min(sessions(spark, sf_dir), AS_OF))


@register("demand_hourly", O.rounded(O.with_ctes(*O.BASE, O.DEMAND_5MIN, O.DEMAND_HOURLY)
                                     + " SELECT * FROM demand_hourly", O.DEMAND_DOUBLES))
def q_demand_hourly(spark, sf_dir):
    return rounded(R.rollup(R.demand_5min(sessions(spark, sf_dir), AS_OF), "hour"))


@register("demand_daily", O.rounded(O.with_ctes(*O.BASE, O.DEMAND_5MIN, O.DEMAND_DAILY)
                                    + " SELECT * FROM demand_daily", O.DEMAND_DOUBLES))
def q_demand_daily(spark, sf_dir):
    return rounded(R.rollup(R.demand_5min(sessions(spark, sf_dir), AS_OF), "day"))


@register("demand_monthly", O.rounded(O.with_ctes(*O.BASE, O.DEMAND_5MIN, O.DEMAND_MONTHLY)
                                      + " SELECT * FROM demand_monthly", O.DEMAND_DOUBLES))
def q_demand_monthly(spark, sf_dir):
    return rounded(R.rollup(R.demand_5min(sessions(spark, sf_dir), AS_OF), "month"))


# ---- step 2: ranges ----------------------------------------------------------------------


_HOURLY = O.with_ctes(*O.BASE, O.DEMAND_5MIN, O.DEMAND_HOURLY)
_DAILY = O.with_ctes(*O.BASE, O.DEMAND_5MIN, O.DEMAND_DAILY)


def _d5(spark, sf_dir):
    return R.demand_5min(sessions(spark, sf_dir), AS_OF)


@register("series_range", O.rounded(_HOURLY + """
  SELECT time, energy_demand_kWh, day FROM demand_hourly
  WHERE time >= TIMESTAMP '2024-01-10' AND time <= TIMESTAMP '2024-01-20'""", ["energy_demand_kWh"]))
def q_series_range(spark, sf_dir):
    hourly = R.rollup(_d5(spark, sf_dir), "hour")
    return rounded(X.series_range(hourly, "demand_hourly", "energy_demand_kWh", "2024-01-10", "2024-01-20"))


@register("series_relative_range", O.rounded(_DAILY + """
  SELECT time, peak_power_kW, day FROM demand_daily
  WHERE time >= TIMESTAMP '2024-01-23' AND time <= TIMESTAMP '2024-01-31'""", ["peak_power_kW"]))
def q_series_relative_range(spark, sf_dir):
    daily = R.rollup(_d5(spark, sf_dir), "day")
    return rounded(X.series_relative_range(daily, "demand_daily", "peak_power_kW", "last_days", AS_OF, 7))


@register("series_year_to_date", O.rounded(O.with_ctes(O.DAILY_SERIES) + """
  SELECT time, v FROM daily_series
  WHERE time >= TIMESTAMP '2001-01-01' AND time <= TIMESTAMP '2001-07-16'""", ["v"]))
def q_series_year_to_date(spark, sf_dir):
    start, end = X.relative_range("year", FX.DAILY_AS_OF)
    return rounded(X.between_dates(FX.daily_series(spark, sf_dir), "time", start, end))


# ---- step 3: chargers and today ---------------------------------------------------------

_CHARGER_DOUBLES = ["currentChargingRate", "cumEnergy_Wh", "todayEnergy_Wh", "currPowerUtilRate",
                    "currOccupUtilRate", "sch_centsPerHr", "reg_centsPerHr"]


@register("charger_status", O.rounded(O.with_ctes(*O.BASE, O.CHARGERS) + " SELECT * FROM chargers",
                                      _CHARGER_DOUBLES))
def q_charger_status(spark, sf_dir):
    return rounded(ST.charger_status(sessions(spark, sf_dir), AS_OF))


@register("charger_utilization", O.rounded(O.with_ctes(*O.BASE, O.CHARGERS) + """
  SELECT stationId, cumEnergy_Wh / 1000 AS cumEnergy_kWh, todayEnergy_Wh / 1000 AS todayEnergy_kWh,
         currPowerUtilRate * 100 AS power_util_pct, currOccupUtilRate * 100 AS occupancy_util_pct
  FROM chargers""", ["cumEnergy_kWh", "todayEnergy_kWh", "power_util_pct", "occupancy_util_pct"]))
def q_charger_utilization(spark, sf_dir):
    return rounded(ST.charger_utilization(ST.charger_status(sessions(spark, sf_dir), AS_OF)))


@register("todays_sessions", O.rounded(O.with_ctes(*O.TODAY_BASE) + " SELECT * FROM today_rows",
                                       O.SESSION_DOUBLES + ["Power_W"]))
def q_todays_sessions(spark, sf_dir):
    return rounded(TD.todays_sessions(raw(spark, sf_dir), AS_OF))


@register("todays_sessions_power", O.rounded(O.with_ctes(*O.TODAY_BASE) + """,
  ranked AS (SELECT dcosId, row_number() OVER (ORDER BY connectTime, dcosId) AS user_no
             FROM (SELECT dcosId, min(connectTime) AS connectTime FROM today_rows GROUP BY dcosId))
  SELECT dcosId, Time, Power_W / 1000 AS Power_kW, vehicle_model, choice, userId, user_no,
         'User #' || CAST(user_no AS VARCHAR) AS label
  FROM today_rows JOIN ranked USING (dcosId)""", ["Power_kW"]))
def q_todays_sessions_power(spark, sf_dir):
    return rounded(TD.todays_sessions_power(TD.todays_sessions(raw(spark, sf_dir), AS_OF)))


@register("nested_series", O.rounded(O.with_ctes(*O.TODAY_BASE) + " SELECT dcosId, Time, Power_W FROM today_rows",
                                     ["Power_W"]))
def q_nested_series(spark, sf_dir):
    return rounded(TD.explode_nested(TD.nested_series(raw(spark, sf_dir), AS_OF), AS_OF))


@register("energy_by_session_today", O.rounded(O.with_ctes(*O.TODAY_BASE) + """,
  ps AS (SELECT dcosId, max(cumEnergy_Wh) AS e, max(vehicle_model) AS vm FROM today_rows GROUP BY dcosId),
  bm AS (SELECT vm AS vehicle_model, coalesce(sum(e), 0) / 1000 AS energy_kWh, count(*) AS sessions
         FROM ps GROUP BY vm)
  SELECT *, energy_kWh / nullif(sum(energy_kWh) OVER (), 0) AS share FROM bm""", ["energy_kWh", "share"]))
def q_energy_by_session_today(spark, sf_dir):
    return rounded(TD.energy_by_session_today(TD.todays_reports(raw(spark, sf_dir), AS_OF)))


# ---- step 4: analytics and cards ----------------------------------------------------------

@register("cumulative_energy", O.rounded(O.with_ctes(*O.BASE) + """
  SELECT dcosId, finishChargeTime,
         CASE WHEN cumEnergy_Wh IS NOT NULL THEN
           sum(coalesce(cumEnergy_Wh, 0)) OVER (ORDER BY finishChargeTime, dcosId ROWS UNBOUNDED PRECEDING) / 1000
         END AS cum_energy_kWh
  FROM sessions""", ["cum_energy_kWh"]))
def q_cumulative_energy(spark, sf_dir):
    return rounded(A.cumulative_energy(sessions(spark, sf_dir)))


@register("cumulative_energy_daily", O.rounded(O.with_ctes(*O.BASE) + """
  SELECT day, sum(wh) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) / 1000 AS cum_energy_kWh
  FROM (SELECT date_trunc('day', finishChargeTime) AS day, coalesce(sum(cumEnergy_Wh), 0) AS wh
        FROM sessions GROUP BY 1)""", ["cum_energy_kWh"]))
def q_cumulative_energy_daily(spark, sf_dir):
    return rounded(A.cumulative_energy(sessions(spark, sf_dir), grain="day"))


@register("cumulative_users", O.with_ctes(*O.BASE) + """,
  r AS (SELECT dcosId, startChargeTime, userId FROM sessions WHERE userId IS NOT NULL),
  f AS (SELECT userId, min(startChargeTime) AS fs FROM r GROUP BY userId)
  SELECT r.dcosId, r.startChargeTime, r.userId, count(*) AS cumulative_users
  FROM r JOIN f ON f.fs < r.startChargeTime OR (f.fs = r.startChargeTime AND f.userId <= r.userId)
  GROUP BY r.dcosId, r.startChargeTime, r.userId""")
def q_cumulative_users(spark, sf_dir):
    return A.cumulative_users(sessions(spark, sf_dir))


@register("top_vehicle_models", O.rounded(O.with_ctes(*O.BASE) + """
  SELECT vehicle_model, coalesce(sum(cumEnergy_Wh), 0) AS cumEnergy_Wh,
         round_even(coalesce(sum(cumEnergy_Wh), 0) / 1000, 1) AS cumEnergy_kWh
  FROM sessions WHERE vehicle_model IS NOT NULL GROUP BY vehicle_model
  ORDER BY cumEnergy_Wh DESC, vehicle_model LIMIT 20""", ["cumEnergy_Wh", "cumEnergy_kWh"]))
def q_top_vehicle_models(spark, sf_dir):
    return rounded(A.top_vehicle_models(sessions(spark, sf_dir), 20))


@register("choice_by_price", O.with_ctes(*O.BASE) + """
  SELECT sch_centsPerHr, reg_centsPerHr, choice, count(*) AS counts FROM sessions
  WHERE sch_centsPerHr IS NOT NULL AND reg_centsPerHr IS NOT NULL AND choice IS NOT NULL
  GROUP BY ALL""")
def q_choice_by_price(spark, sf_dir):
    return A.choice_by_price(sessions(spark, sf_dir))


@register("user_profile", O.rounded(O.with_ctes(*O.BASE) + f""",
  b AS (SELECT *, {O.PART_OF_DAY} AS part FROM sessions WHERE userId IS NOT NULL),
  pc AS (SELECT userId, part, row_number() OVER (PARTITION BY userId ORDER BY count(*) DESC, part) AS rn
         FROM b GROUP BY userId, part),
  cc AS (SELECT userId, choice, count(*) AS n,
                row_number() OVER (PARTITION BY userId ORDER BY count(*) DESC, choice) AS rn
         FROM b WHERE choice IS NOT NULL GROUP BY userId, choice),
  m AS (SELECT userId, count(*) AS num_sessions, round_even(avg(DurationHrs), 2) AS average_duration,
               coalesce(sum(cumEnergy_Wh), 0) / 1000 AS total_nrg_consumed FROM b GROUP BY userId)
  SELECT m.userId, m.num_sessions, m.average_duration, pc.part AS freq_connect_time, m.total_nrg_consumed,
         cc.choice AS pref_charging_choice, coalesce(cc.n, 0) / m.num_sessions AS pref_charging_choice_percent
  FROM m JOIN pc ON pc.userId = m.userId AND pc.rn = 1
  LEFT JOIN cc ON cc.userId = m.userId AND cc.rn = 1""",
    ["average_duration", "total_nrg_consumed", "pref_charging_choice_percent"]))
def q_user_profile(spark, sf_dir):
    return rounded(A.user_profile(C.session_subset(sessions(spark, sf_dir))))


def _hist_sql(source: str, group_expr: str, group_name: str, q: str, bins: int = 10) -> str:
    return f""",
  t AS (SELECT {group_expr} AS {group_name}, {q} AS x FROM {source} WHERE {q} IS NOT NULL),
  s AS (SELECT {group_name}, min(x) AS lo, max(x) AS hi, count(*) AS n FROM t GROUP BY {group_name}),
  b AS (SELECT t.{group_name}, CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1})
                                 ELSE 0 END AS INTEGER) AS bin, lo, hi, n
        FROM t JOIN s ON s.{group_name} = t.{group_name})
  SELECT {group_name}, bin, lo + bin * ((hi - lo) / {bins}) AS bin_lo,
         CASE WHEN bin = {bins - 1} THEN hi ELSE lo + (bin + 1) * ((hi - lo) / {bins}) END AS bin_hi,
         count(*) AS count, count(*) * 100.0 / n AS percent
  FROM b GROUP BY {group_name}, bin, lo, hi, n"""


@register("histogram_by_weekday", O.rounded(_DAILY + _hist_sql("demand_daily", "day", "day", "energy_demand_kWh"),
                                            ["bin_lo", "bin_hi", "percent"]))
def q_histogram_by_weekday(spark, sf_dir):
    return rounded(A.histogram_by_weekday(R.rollup(_d5(spark, sf_dir), "day"), "energy_demand_kWh"))


@register("histogram_by_hour", O.rounded(_HOURLY + _hist_sql("demand_hourly", "CAST(hour(time) AS INTEGER)",
                                                             "hour", "avg_power_demand_kW"),
                                         ["bin_lo", "bin_hi", "percent"]))
def q_histogram_by_hour(spark, sf_dir):
    return rounded(A.histogram_by_hour(R.rollup(_d5(spark, sf_dir), "hour"), "avg_power_demand_kW"))


@register("yesterday_overlay", O.rounded(O.with_ctes(*O.BASE, O.DEMAND_5MIN) + f""",
  y AS (SELECT time + INTERVAL 1 DAY AS time, avg_power_demand_kW AS yv, CAST(NULL AS DOUBLE) AS tv
        FROM demand_5min WHERE time >= {O.YESTERDAY} AND time <= {O.TODAY}),
  t AS (SELECT time, CAST(NULL AS DOUBLE) AS yv, avg_power_demand_kW AS tv
        FROM demand_5min WHERE time >= {O.TODAY} AND time <= {O.TODAY} + INTERVAL 1 DAY)
  SELECT time, max(yv) AS yesterday_avg_power_demand_kW, max(tv) AS today_avg_power_demand_kW
  FROM (SELECT * FROM y UNION ALL SELECT * FROM t) GROUP BY time""",
    ["yesterday_avg_power_demand_kW", "today_avg_power_demand_kW"]))
def q_yesterday_overlay(spark, sf_dir):
    return rounded(A.yesterday_overlay(_d5(spark, sf_dir), AS_OF))


@register("kpi_today", O.rounded(O.with_ctes(*O.BASE, O.TODAY_SESSIONS, O.TODAY_SLOTS, O.DEMAND_5MIN, O.DEMAND_DAILY)
                                 + f""",
  k AS (SELECT
    (SELECT coalesce(sum(e), 0) / 1000 FROM (SELECT dcosId, max(cumEnergy_Wh) AS e FROM today_rows GROUP BY dcosId))
      AS kwh_today,
    (SELECT count(DISTINCT dcosId) FROM today_rows) AS sessions_today,
    (SELECT count(DISTINCT userId) FROM today_rows) AS users_today,
    (SELECT coalesce(max(energy_demand_kWh), 0) FROM demand_daily WHERE time = {O.YESTERDAY}) AS kwh_yesterday,
    (SELECT count(DISTINCT userId) FROM sessions WHERE date_trunc('day', connectTime) = {O.YESTERDAY})
      AS users_yesterday)
  SELECT *, {O.pct_change('kwh_today', 'kwh_yesterday')} AS kwh_change_pct,
         {O.direction(O.pct_change('kwh_today', 'kwh_yesterday'))} AS kwh_direction,
         sessions_today - users_yesterday AS users_change,
         {O.direction('sessions_today - users_yesterday')} AS users_direction
  FROM k""", ["kwh_today", "kwh_yesterday", "kwh_change_pct"]))
def q_kpi_today(spark, sf_dir):
    return rounded(K.kpi_today(raw(spark, sf_dir), AS_OF))


_TODAY_CARD = O.with_ctes(*O.BASE, O.TODAY_SESSIONS, O.TODAY_SLOTS, O.DEMAND_5MIN, O.DEMAND_DAILY, O.DEMAND_MONTHLY) + f""",
  k AS (SELECT
    (SELECT coalesce(sum(e), 0) / 1000 FROM (SELECT dcosId, max(cumEnergy_Wh) AS e FROM today_rows GROUP BY dcosId)) AS kwh,
    (SELECT count(DISTINCT dcosId) FROM today_rows) AS n,
    (SELECT coalesce(max(energy_demand_kWh), 0) FROM demand_daily WHERE time = {O.YESTERDAY}) AS kwh0,
    (SELECT count(DISTINCT userId) FROM sessions WHERE date_trunc('day', connectTime) = {O.YESTERDAY}) AS n0,
    (SELECT arg_max(peak_power_kW, time) FROM demand_monthly) AS peak,
    (SELECT lag(peak_power_kW) OVER (ORDER BY time) AS p FROM demand_monthly QUALIFY row_number() OVER (ORDER BY time DESC) = 1)
      AS peak0),
  c AS (SELECT *, {O.pct_change('kwh', 'kwh0')} AS kc, n - n0 AS nc, {O.pct_change('peak', 'peak0')} AS pc FROM k)
  SELECT format('{{:,.1f}}', round_even(kwh, 1)) || ' kWh' AS kwh_today_text, format('{{:,}}', n) AS users_today_text,
         CASE WHEN kc = 0 THEN 'No change since yesterday!' ELSE printf('%+.0f%% since yesterday!', round_even(kc, 0)) END
           AS kwh_change_text,
         CASE WHEN nc = 0 THEN 'No change since yesterday!' ELSE printf('%+d users since yesterday!', nc) END
           AS users_change_text,
         format('{{:,.1f}}', round_even(peak, 1)) || ' kW' AS peak_text,
         CASE WHEN pc = 0 THEN 'No change since last month!' ELSE printf('%+.1f%% since last month!', round_even(pc, 1)) END
           AS peak_change_text
  FROM c"""


@register("kpi_today_text", _TODAY_CARD)
def q_kpi_today_text(spark, sf_dir):
    monthly = R.rollup(_d5(spark, sf_dir), "month")
    return K.today_card_text(K.kpi_today(raw(spark, sf_dir), AS_OF), K.kpi_month_peak(monthly))


@register("kpi_month_peak", O.rounded(O.with_ctes(O.DAILY_SERIES) + f""",
  m AS (SELECT CAST(last_day(time) AS TIMESTAMP) AS time, max(v) AS peak_power_kW FROM daily_series GROUP BY 1),
  l AS (SELECT *, lag(peak_power_kW) OVER (ORDER BY time) AS previous_peak_power_kW FROM m
        QUALIFY row_number() OVER (ORDER BY time DESC) = 1)
  SELECT time, peak_power_kW, previous_peak_power_kW,
         {O.pct_change('peak_power_kW', 'previous_peak_power_kW')} AS change_pct,
         {O.direction(O.pct_change('peak_power_kW', 'previous_peak_power_kW'))} AS direction
  FROM l""", ["peak_power_kW", "previous_peak_power_kW", "change_pct"]))
def q_kpi_month_peak(spark, sf_dir):
    from loadcurve.functions.timecols import month_end
    monthly = (FX.daily_series(spark, sf_dir).groupBy(month_end("time").alias("time"))
               .agg(F.max("v").alias("peak_power_kW")))
    return rounded(K.kpi_month_peak(monthly, "peak_power_kW"))


_WEEKS = (AS_OF - K.SERVICE_START).days // 7


@register("kpi_cumulative", O.rounded(O.with_ctes(*O.BASE) + f"""
  SELECT count(*) AS cum_sessions,
         count(*) FILTER (WHERE choice = 'REGULAR') AS regular_sessions,
         count(*) FILTER (WHERE choice = 'SCHEDULED') AS scheduled_sessions,
         (count(*) FILTER (WHERE choice = 'REGULAR')) / nullif(count(*), 0) AS regular_share,
         (count(*) FILTER (WHERE choice = 'SCHEDULED')) / nullif(count(*), 0) AS scheduled_share,
         coalesce(sum(cumEnergy_Wh), 0) / 1000 AS cum_kwh,
         coalesce(sum(cumEnergy_Wh), 0) / 1000 / 10649.0 AS home_years,
         coalesce(sum(cumEnergy_Wh), 0) / 290.0 AS emiles,
         coalesce(sum(cumEnergy_Wh), 0) / 290.0 / 5810.0 AS round_trips,
         CAST({_WEEKS} AS BIGINT) AS weeks,
         count(*) / {float(_WEEKS)} AS sessions_per_week
  FROM sessions""", ["regular_share", "scheduled_share", "cum_kwh", "home_years", "emiles", "round_trips",
                     "sessions_per_week"]))
def q_kpi_cumulative(spark, sf_dir):
    return rounded(K.kpi_cumulative(C.session_subset(sessions(spark, sf_dir)), AS_OF))


# ---- step 5: grid requests ---------------------------------------------------------------


_GRID_BASE = (O.with_ctes(*O.BASE) + ", g AS (SELECT * EXCLUDE (userId, finishChargeTime, true_peakPower_W, "
              "Overstay_s, Overstay_h, Overstay_total_h) FROM sessions)")
_GRID_DOUBLES = ["DurationHrs", "cumEnergy_Wh", "peakPower_W"]

GRID_REQUESTS = {
    "grid_compare": {"filterModel": {
        "cumEnergy_Wh": {"filterType": "number", "type": "greaterThanOrEqual", "filter": "20000"},
        "stationId": {"filterType": "number", "type": "notEqual", "filter": 3},
        "sch_centsPerHr": {"filterType": "number", "type": "lessThan", "filter": 130}}},
    "grid_text": {"filterModel": {
        "vehicle_model": {"filterType": "text", "type": "contains", "filter": "model_1[0-4]"},
        "Duration": {"filterType": "text", "type": "startsWith", "filter": "0 days 01"},
        "choice": {"filterType": "text", "type": "notEndsWith", "filter": "LED"}}},
    "grid_range": {"filterModel": {
        "DurationHrs": {"filterType": "number", "type": "inRange", "filter": 0.5, "filterTo": 1.5},
        "connectTime": {"filterType": "date", "type": "inRange", "dateFrom": "2024-01-10 00:00:00",
                        "dateTo": "2024-01-20 00:00:00"}}},
    "grid_blank": {"filterModel": {
        "vehicle_model": {"filterType": "text", "type": "blank"},
        "Deadline": {"filterType": "date", "type": "notBlank"}}},
    "grid_and_or": {"filterModel": {
        "cumEnergy_Wh": {"filterType": "number", "operator": "OR",
                         "condition1": {"filterType": "number", "type": "lessThan", "filter": 5000},
                         "condition2": {"filterType": "number", "type": "lessThan", "filter": 8000}},
        "stationId": {"filterType": "number", "operator": "AND",
                      "condition1": {"filterType": "number", "type": "greaterThan", "filter": 2},
                      "condition2": {"filterType": "number", "type": "lessThanOrEqual", "filter": 6}}}},
    "grid_page": {"filterModel": {"vehicle_model": {"filterType": "text", "type": "notBlank"}},
                  "sortModel": [{"colId": "stationId", "sort": "asc"}, {"colId": "cumEnergy_Wh", "sort": "desc"}],
                  "startRow": 100, "endRow": 200},
}

_GRID_SQL = {
    "grid_compare": "cumEnergy_Wh >= 20000 AND (stationId <> 3 OR stationId IS NULL) AND sch_centsPerHr < 130",
    "grid_text": ("regexp_matches(vehicle_model, 'model_1[0-4]') AND starts_with(Duration, '0 days 01') "
                  "AND (NOT ends_with(choice, 'LED') OR choice IS NULL)"),
    "grid_range": ("DurationHrs BETWEEN 0.5 AND 1.5 AND connectTime BETWEEN TIMESTAMP '2024-01-10 00:00:00' "
                   "AND TIMESTAMP '2024-01-20 00:00:00'"),
    "grid_blank": "vehicle_model IS NULL AND Deadline IS NOT NULL",
    "grid_and_or": "(cumEnergy_Wh < 5000 OR cumEnergy_Wh < 8000) AND (stationId > 2 AND stationId <= 6)",
}


def _grid_query(name):
    def run(spark, sf_dir):
        return rounded(G.grid_query(G.grid_table(sessions(spark, sf_dir)), GRID_REQUESTS[name]).rows)
    run.__name__ = f"q_{name}"
    return run


for _name, _where in _GRID_SQL.items():
    register(_name, O.rounded(_GRID_BASE + f" SELECT * FROM g WHERE {_where}", _GRID_DOUBLES))(_grid_query(_name))

register("grid_page", O.rounded(_GRID_BASE + """
  SELECT * FROM g WHERE vehicle_model IS NOT NULL
  ORDER BY stationId ASC NULLS LAST, cumEnergy_Wh DESC NULLS LAST, connectTime DESC NULLS LAST, dcosId DESC NULLS LAST
  LIMIT 100 OFFSET 100""", _GRID_DOUBLES))(_grid_query("grid_page"))


_PAGES_SQL = _GRID_BASE + """,
  r AS (SELECT *, row_number() OVER (ORDER BY stationId ASC NULLS LAST, cumEnergy_Wh DESC NULLS LAST,
          connectTime DESC NULLS LAST, dcosId DESC NULLS LAST) - 1 AS position, count(*) OVER () AS row_count
        FROM g WHERE vehicle_model IS NOT NULL)
  SELECT 'first' AS page, * FROM r WHERE position < 50
  UNION ALL SELECT 'middle', * FROM r WHERE position >= row_count // 2 AND position < row_count // 2 + 70
  UNION ALL SELECT 'rest', * FROM r WHERE position >= row_count * 3 // 4"""


@register("grid_pages", O.rounded(_PAGES_SQL, _GRID_DOUBLES))
def q_grid_pages(spark, sf_dir):
    """Pages at the start, in the middle and without an end, and the row count, from one index."""
    index = G.PageIndex.build(G.grid_table(sessions(spark, sf_dir)), GRID_REQUESTS["grid_page"], rows_per_range=1000)
    n = index.row_count
    pages = {"first": (0, 50), "middle": (n // 2, n // 2 + 70), "rest": (n * 3 // 4, None)}
    made = [index.page(*bounds, position="position").select(F.lit(name).alias("page"), "*")
            for name, bounds in pages.items()]
    return rounded(functools.reduce(DataFrame.unionByName, made).withColumn("row_count", F.lit(n).cast("long")))


@register("grid_literal", O.rounded(_GRID_BASE + """
  SELECT * FROM g WHERE (contains(Duration, '1:0') OR contains(Duration, '.')) AND NOT contains(Duration, '3.')
    AND choice = 'REGULAR' AND NOT starts_with(vehicle_model, 'model_1') AND ends_with(vehicle_model, '2')
    AND (NOT regexp_matches(vehicle_model, '2[0-2]') OR vehicle_model IS NULL)""", _GRID_DOUBLES))
def q_grid_literal(spark, sf_dir):
    """Text conditions taken literally, equality, and the negated forms in several conditions on a column."""
    text = lambda kind, value, **more: {"filterType": "text", "type": kind, "filter": value, **more}
    grid = G.grid_table(sessions(spark, sf_dir))
    first = G.grid_query(grid, {"filterModel": {
        "Duration": {"filterType": "text", "operator": "OR", "condition1": text("contains", "1:0", literal=True),
                     "condition2": text("contains", ".", literal=True)},
        "choice": text("equals", "REGULAR"),
        "vehicle_model": {"filterType": "text", "operator": "AND", "condition1": text("notStartsWith", "model_1"),
                          "condition2": text("endsWith", "2")}}}).rows
    return rounded(G.grid_query(first, {"filterModel": {
        "Duration": text("notContains", "3.", literal=True), "vehicle_model": text("notContains", "2[0-2]")}}).rows)


# ---- step 6: lags, splits, kNN, forecast tables -----------------------------------------


LAG_DEPTH = 7
KNN_DEPTH, KNN_K = 6, 11                  # a forecast with fixed parameters
# the reference's whole grid, 21 x 16 pairs; with lags one row apart it fits a month of hours
GRID_DEPTHS, GRID_KS, GRID_PERIOD = KNN_DEPTHS, KNN_KS, 1
_HS = O.with_ctes(O.HOURLY_SERIES)
_LAGS7 = [f"lag{k}" for k in range(1, LAG_DEPTH + 1)]


@register("lag_features", O.rounded(_HS + f"""
  SELECT * FROM (SELECT *, {O.lag_cols(LAG_DEPTH)} FROM hourly_series) WHERE {O.lags_not_null(LAG_DEPTH)}""",
    ["v"] + _LAGS7))
def q_lag_features(spark, sf_dir):
    return rounded(FE.lag_features(FX.hourly_series(spark, sf_dir), LAG_DEPTH))


@register("lag_subset", O.rounded(_HS + f"""
  SELECT time, lag1, lag2, lag3 FROM (SELECT *, {O.lag_cols(LAG_DEPTH)} FROM hourly_series)
  WHERE {O.lags_not_null(LAG_DEPTH)}""", ["lag1", "lag2", "lag3"]))
def q_lag_subset(spark, sf_dir):
    return rounded(FE.subset_lags(FE.lag_features(FX.hourly_series(spark, sf_dir), LAG_DEPTH), 3, keep=["time"]))


@register("chrono_split", _HS + f""",
  f AS (SELECT * FROM (SELECT *, {O.lag_cols(LAG_DEPTH)} FROM hourly_series) WHERE {O.lags_not_null(LAG_DEPTH)}),
  s AS (SELECT time, row_number() OVER (ORDER BY time) AS rn, count(*) OVER () AS n FROM f)
  SELECT time, {O.split_case()} AS split FROM s""")
def q_chrono_split(spark, sf_dir):
    return FE.chrono_split(FE.lag_features(FX.hourly_series(spark, sf_dir), LAG_DEPTH)).select("time", "split")


@register("knn_forecast", O.rounded(_HS + f""",
  ext AS (SELECT time, v, false AS fut FROM hourly_series
          UNION ALL SELECT (SELECT max(time) FROM hourly_series) + to_hours(k), 0.0, true FROM range(1, 25) r(k)),
  f AS (SELECT *, {O.lag_cols(KNN_DEPTH)} FROM ext),
  q AS (SELECT * FROM f WHERE fut AND {O.lags_not_null(KNN_DEPTH)}),
  t AS (SELECT * FROM f WHERE NOT fut AND v IS NOT NULL AND {O.lags_not_null(KNN_DEPTH)}),
  p AS (SELECT q.time AS q_time, t.time AS t_time, t.v AS t_y, {O.dist(KNN_DEPTH)} AS d FROM q, t),
  r AS (SELECT *, row_number() OVER (PARTITION BY q_time ORDER BY d, t_time) AS rk FROM p)
  SELECT q_time AS time, avg(t_y) AS v_predictions FROM r WHERE rk <= {KNN_K} GROUP BY q_time""",
    ["v_predictions"]))
def q_knn_forecast(spark, sf_dir):
    return rounded(KN.knn_forecast(FX.hourly_series(spark, sf_dir).select("time", "v"), KNN_DEPTH, KNN_K))


_GRID_MAX = max(GRID_DEPTHS)
_SCORES_SQL = _HS + f""",
  f AS (SELECT * FROM (SELECT *, {O.lag_cols(_GRID_MAX, period=GRID_PERIOD)} FROM hourly_series) WHERE {O.lags_not_null(_GRID_MAX)}),
  s AS (SELECT *, row_number() OVER (ORDER BY time) AS rn, count(*) OVER () AS n FROM f),
  sp AS (SELECT *, {O.split_case()} AS split FROM s),
  q AS (SELECT * FROM sp WHERE split = 'validation'),
  t AS (SELECT * FROM sp WHERE split = 'train'),
  pd AS ({" UNION ALL ".join(
      f"SELECT q.time AS q_time, q.v AS q_y, t.time AS t_time, t.v AS t_y, {d} AS depth, {O.dist(d)} AS d FROM q, t"
      for d in GRID_DEPTHS)}),
  r AS (SELECT *, row_number() OVER (PARTITION BY q_time, depth ORDER BY d, t_time) AS k FROM pd),
  r2 AS (SELECT *, avg(t_y) OVER (PARTITION BY q_time, depth ORDER BY d, t_time ROWS UNBOUNDED PRECEDING) AS pred
         FROM r WHERE k <= {max(GRID_KS)}),
  scores AS (SELECT depth, CAST(k AS INTEGER) AS k, avg((pred - q_y) * (pred - q_y)) AS mse
             FROM r2 WHERE k >= {min(GRID_KS)} GROUP BY depth, k)"""


@register("knn_grid_scores", O.rounded(_SCORES_SQL + " SELECT * FROM scores", ["mse"]))
def q_knn_grid_scores(spark, sf_dir):
    return rounded(KN.knn_grid_scores(FX.hourly_series(spark, sf_dir).select("time", "v"), GRID_DEPTHS, GRID_KS,
                                       period=GRID_PERIOD))


@register("knn_grid_search", O.rounded(_SCORES_SQL + """
  SELECT CAST(depth AS INTEGER) AS best_depth, CAST(k AS INTEGER) AS best_n_neighbors, mse
  FROM scores ORDER BY mse, k, depth LIMIT 1""", ["mse"]))
def q_knn_grid_search(spark, sf_dir):
    return rounded(KN.knn_grid_search(FX.hourly_series(spark, sf_dir).select("time", "v"), GRID_DEPTHS, GRID_KS,
                                       period=GRID_PERIOD))


def _runs(spark, sf_dir):
    hs = FX.hourly_series(spark, sf_dir)
    v = F.col("v")
    existing = hs.select(
        "time", v.alias("avg_power_demand_kW_predictions"),
        F.when(F.floor(v) % 5 == 0, F.lit(None).cast("double")).otherwise(v / 12).alias("energy_demand_kWh_predictions"),
        (v * 1.5).alias("peak_power_kW_predictions"))
    new = hs.select(
        F.timestamp_add("HOUR", F.lit(360), F.col("time")).alias("time"),
        F.when(F.floor(v) % 7 == 0, F.lit(None).cast("double")).otherwise(v * 1.1).alias("avg_power_demand_kW_predictions"),
        (v * 1.1 / 12).alias("energy_demand_kWh_predictions"),
        F.when(v == 0, F.lit(None).cast("double")).otherwise(v * 1.6).alias("peak_power_kW_predictions"))
    return existing, new


@register("forecast_upsert", O.rounded(O.with_ctes(O.HOURLY_SERIES, O.RUNS) + " SELECT * FROM upserted",
                                       O.PRED_COLS))
def q_forecast_upsert(spark, sf_dir):
    existing, new = _runs(spark, sf_dir)
    return rounded(FC.upsert_forecasts(existing, new, "hour"))


@register("forecast_postprocess", O.rounded(O.with_ctes(O.HOURLY_SERIES, O.RUNS) + " SELECT time, " + ", ".join(
    f"CASE WHEN hour(time) <= 5 THEN 0.0 ELSE greatest(0.0, coalesce({c}, 0.0)) END AS {c}" for c in O.PRED_COLS)
    + " FROM upserted", O.PRED_COLS))
def q_forecast_postprocess(spark, sf_dir):
    existing, new = _runs(spark, sf_dir)
    return rounded(FC.clamp_hourly(FC.upsert_forecasts(existing, new, "hour")))


@register("actual_vs_forecast", O.rounded(O.with_ctes(O.HOURLY_SERIES, O.RUNS) + """
  SELECT coalesce(a.time, f.time) AS time, a.v AS actual, f.avg_power_demand_kW_predictions AS predicted,
         f.avg_power_demand_kW_predictions - a.v AS error
  FROM (SELECT time, v FROM hourly_series WHERE time >= TIMESTAMP '2024-01-10') a
  FULL OUTER JOIN (SELECT * FROM upserted WHERE time >= TIMESTAMP '2024-01-10') f ON f.time = a.time""",
    ["actual", "predicted", "error"]))
def q_actual_vs_forecast(spark, sf_dir):
    existing, new = _runs(spark, sf_dir)
    fc = FC.upsert_forecasts(existing, new, "hour")
    actual = FX.hourly_series(spark, sf_dir).select("time", F.col("v").alias("avg_power_demand_kW"))
    return rounded(FC.actual_vs_forecast(actual, fc, "avg_power_demand_kW", "2024-01-10"))


# ---- step 7: seasonal daily model ------------------------------------------------------------


DAILY_END = "(SELECT max(time) FROM daily_series)"


def _daily_forecast_sql(out_col: str, where: str = "") -> str:
    return "WITH RECURSIVE " + O.DAILY_SERIES.strip() + f""",
  w AS (SELECT time, v, v - lag(v, 7) OVER (ORDER BY time) AS w FROM daily_series),
  x AS (SELECT time, v, w, lag(w, 1) OVER (ORDER BY time) AS w1 FROM w),
  c AS (SELECT regr_slope(w, w1) AS b, regr_intercept(w, w1) AS a FROM x WHERE w IS NOT NULL AND w1 IS NOT NULL),
  r(h, wh) AS (
    SELECT 1, c.a + c.b * (SELECT w FROM x WHERE time = {DAILY_END}) FROM c
    UNION ALL SELECT r.h + 1, c.a + c.b * r.wh FROM r, c WHERE r.h < 7)
  SELECT * FROM (
    SELECT {DAILY_END} + to_days(r.h) AS time, ds.v + r.wh AS {out_col}
    FROM r JOIN daily_series ds ON ds.time = {DAILY_END} + to_days(r.h - 7)) q {where}"""


@register("daily_forecast", O.rounded(_daily_forecast_sql("v_predictions"), ["v_predictions"], 1))
def q_daily_forecast(spark, sf_dir):
    return rounded(SE.seasonal_forecast(FX.daily_series(spark, sf_dir), p=1, P=0), 1)


def _order_search_sql(max_p: int, max_P: int) -> str:
    """Every order's AIC by taking the regressors out one after another (centred Gram-Schmidt steps)."""
    lags = [*range(1, max_p + 1), *(7 * i for i in range(1, max_P + 1))]
    ctes, found = [], []
    for p in range(max_p + 1):
        for P in range(max_P + 1):
            own = [*range(1, p + 1), *(7 * i for i in range(1, P + 1))]
            last = "centred"
            for step, lag in enumerate(own):
                name = f"c{p}_{P}_{step}"
                rest = ["y", *(f"x{x}" for x in own[step + 1:])]
                ctes.append(f"{name} AS (SELECT " + ", ".join(
                    f"{v} - x{lag} * (sum({v} * x{lag}) OVER () / sum(x{lag} * x{lag}) OVER ()) AS {v}" for v in rest)
                    + f" FROM {last})")
                last = name
            found.append(f"SELECT {p} AS p, {P} AS sp, count(*) * ln(sum(y * y) / count(*)) + {2 * (len(own) + 2)} AS aic, "
                         f"count(*) AS n FROM {last}")
    return O.with_ctes(O.DAILY_SERIES, f"""
  r AS (SELECT time, v, v - lag(v, 7) OVER (ORDER BY time) AS w FROM daily_series
        QUALIFY row_number() OVER (ORDER BY time) <= count(*) OVER () - ceil(count(*) OVER () * CAST({1 - 0.8!r} AS DOUBLE))),
  l AS (SELECT w AS y, {", ".join(f"lag(w, {x}) OVER (ORDER BY time) AS x{x}" for x in lags)} FROM r),
  d AS (SELECT * FROM l WHERE y IS NOT NULL AND {" AND ".join(f"x{x} IS NOT NULL" for x in lags)}),
  centred AS (SELECT {", ".join(f"{v} - avg({v}) OVER () AS {v}" for v in ["y", *(f"x{x}" for x in lags)])} FROM d)""",
        *ctes) + f"""
  SELECT CAST(p AS INTEGER) AS ar_order, CAST(sp AS INTEGER) AS seasonal_ar_order, aic, n
  FROM ({" UNION ALL ".join(found)}) q ORDER BY aic, p + sp, p LIMIT 1"""


@register("daily_order_search", O.rounded(_order_search_sql(2, 2), ["aic"], 4))
def q_daily_order_search(spark, sf_dir):
    return rounded(SE.seasonal_order_search(FX.daily_series(spark, sf_dir), max_p=2, max_P=2), 4)


ARMA_LONG = 7


def _arma_scores_sql(long: int) -> str:
    """Residuals of the long regression by Gram-Schmidt steps, then every candidate's in the same way."""
    def out_of(last, name, step, keep, rest):
        return f"{name} AS (SELECT {keep}" + ", ".join(
            f"{v} - {step} * (sum({v} * {step}) OVER () / sum({step} * {step}) OVER ()) AS {v}" for v in rest) + f" FROM {last})"

    ctes, last = [], "lc"
    for x in range(1, long + 1):
        ctes.append(out_of(last, f"l{x}", f"x{x}", "time, w, ", ["y", *(f"x{i}" for i in range(x + 1, long + 1))]))
        last = f"l{x}"
    cols = ["w1", "w7", "e1", "e7"]
    ctes.append(f"""
  st AS (SELECT w AS y, lag(w, 1) OVER (ORDER BY time) AS w1, lag(w, 7) OVER (ORDER BY time) AS w7,
                lag(y, 1) OVER (ORDER BY time) AS e1, lag(y, 7) OVER (ORDER BY time) AS e7 FROM {last}),
  sc AS (SELECT {", ".join(f"{v} - avg({v}) OVER () AS {v}" for v in ["y", *cols])} FROM st
         WHERE {" AND ".join(f"{v} IS NOT NULL" for v in cols)})""")
    found = []
    for k in range(16):
        own, last = [c for i, c in enumerate(cols) if k >> i & 1], "sc"
        for i, c in enumerate(own):
            ctes.append(out_of(last, f"m{k}_{i}", c, "", ["y", *own[i + 1:]]))
            last = f"m{k}_{i}"
        found.append(f"SELECT {k & 1} AS p, {k >> 2 & 1} AS q, {k >> 1 & 1} AS seasonal_p, {k >> 3 & 1} AS seasonal_q, "
                     f"count(*) * ln(sum(y * y) / count(*)) + {2 * (len(own) + 2)} AS aic, count(*) AS n FROM {last}")
    xs = [f"x{x}" for x in range(1, long + 1)]
    return O.with_ctes(O.DAILY_SERIES, f"""
  wd AS (SELECT time, v - lag(v, 7) OVER (ORDER BY time) AS w FROM daily_series),
  wl AS (SELECT time, w, {", ".join(f"lag(w, {x}) OVER (ORDER BY time) AS x{x}" for x in range(1, long + 1))} FROM wd),
  lc AS (SELECT time, w, w - avg(w) OVER () AS y, {", ".join(f"{x} - avg({x}) OVER () AS {x}" for x in xs)} FROM wl
         WHERE w IS NOT NULL AND {" AND ".join(f"{x} IS NOT NULL" for x in xs)})""", *ctes) + " " + " UNION ALL ".join(found)


@register("arma_order_scores", O.rounded(_arma_scores_sql(ARMA_LONG), ["aic"], 3))
def q_arma_order_scores(spark, sf_dir):
    """AIC of the 16 daily models with up to one term of each kind, moving-average terms included."""
    return rounded(ARMA.arma_scores(FX.daily_series(spark, sf_dir), 1, 1, 1, 1, ARMA_LONG), 3)


@register("peak_forecast_today", O.rounded(
    _daily_forecast_sql("peak_power_kW_predictions", "WHERE time = TIMESTAMP '2001-08-02'"),
    ["peak_power_kW_predictions"], 1))
def q_peak_forecast_today(spark, sf_dir):
    series = FX.daily_series(spark, sf_dir).withColumnRenamed("v", "peak_power_kW")
    fc = SE.seasonal_forecast(series, p=1, P=0, value_col="peak_power_kW")
    return rounded(FC.peak_forecast_today(fc, "2001-08-02 12:00:00"), 1)


# ---- step 8: tables, CSV, flattening ----------------------------------------------------------


@register("table_roundtrip", O.rounded(O.with_ctes(*O.BASE) + " SELECT * FROM sessions", O.SESSION_DOUBLES))
def q_table_roundtrip(spark, sf_dir):
    root = scratch_path(spark, "tables")
    s = sessions(spark, sf_dir)
    TB.write_table(s.withColumn("day", F.to_date("connectTime")), "sessions", root, partition_by=["day"])
    TB.write_table(C.session_subset(s), "sessions_subset", root)
    assert TB.table_exists(spark, "sessions", root) and not TB.table_exists(spark, "nothing_here", root)
    full, _subset = TB.read_tables(spark, ["sessions", "sessions_subset"], root)
    return rounded(full.drop("day").select(*s.columns))


_SUBSET_SCHEMA = T.StructType([
    T.StructField("connectTime", T.TimestampNTZType()), T.StructField("userId", T.StringType()),
    T.StructField("cumEnergy_Wh", T.DoubleType()), T.StructField("DurationHrs", T.DoubleType()),
    T.StructField("choice", T.StringType())])


@register("csv_roundtrip", O.rounded(
    O.with_ctes(*O.BASE) + " SELECT connectTime, userId, cumEnergy_Wh, DurationHrs, choice FROM sessions",
    ["cumEnergy_Wh", "DurationHrs"]))
def q_csv_roundtrip(spark, sf_dir):
    path = TB.write_csv(C.session_subset(sessions(spark, sf_dir)), scratch_path(spark, "csv"))
    return rounded(TB.read_csv(spark, path, _SUBSET_SCHEMA))


@register("clean_text_sessions", O.rounded(O.with_ctes(*O.BASE) + " SELECT * FROM sessions", O.SESSION_DOUBLES))
def q_clean_text_sessions(spark, sf_dir):
    """Sessions whose dates and ids arrive as JSON text, scanned, parsed and cleaned."""
    r = raw(spark, sf_dir)
    path = scratch_path(spark, "session-texts")
    text = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in TB.DATE_COLUMNS}
    r.withColumns(text | {c: F.col(c).cast("string") for c in TB.ID_COLUMNS}).write.json(path)
    return rounded(C.clean_sessions(TB.scan_session_texts(spark, path, "json")))


@register("flatten_records", """
  SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS "props.k" FROM events""")
def q_flatten_records(spark, sf_dir):
    ev = FX.table(spark, sf_dir, "events").select("event_id", "props")
    return TB.flatten(TB.parse_json(ev, "props", "k int"))


# ---- step 9: streaming ----------------------------------------------------------------------


STATE_PARTITIONS = 8          # state-store partitions of stream_charger_state (eight stations)

_EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


@register("stream_demand_5min", O.rounded(O.with_ctes(*O.BASE) + f""",
  slots AS (
    SELECT slot, w FROM (
      SELECT unnest(generate_series({O.LO}, {O.HI})) AS slot, true_peakPower_W AS w
      FROM sessions WHERE {O.LO} <= {O.HI})
    WHERE slot <= {O.END_IDX}),
  agg AS (SELECT {O.slot_ts('slot')} AS time, sum(w) AS power_W, sum(w) / 12000.0 AS energy_kWh
          FROM slots GROUP BY slot)
  SELECT * FROM agg
  WHERE time + INTERVAL 5 MINUTE <= (SELECT max(time) FROM agg) - INTERVAL 16 MINUTE""", ["power_W", "energy_kWh"]))
def q_stream_demand_5min(spark, sf_dir):
    return rounded(SD.stream_demand(spark, f"{sf_dir}/events.parquet", AS_OF, _EVENTS_SCHEMA))


@register("stream_demand_hourly", O.rounded(O.with_ctes(*O.BASE) + f""",
  slots AS (
    SELECT slot, w FROM (
      SELECT unnest(generate_series({O.LO}, {O.HI})) AS slot, true_peakPower_W AS w
      FROM sessions WHERE {O.LO} <= {O.HI})
    WHERE slot <= {O.END_IDX}),
  agg AS (SELECT date_trunc('hour', {O.slot_ts('slot')}) AS time, sum(w) AS power_W, sum(w) / 12000.0 AS energy_kWh
          FROM slots GROUP BY 1),
  mx AS (SELECT max({O.slot_ts('slot')}) AS m FROM slots)
  SELECT agg.* FROM agg, mx WHERE time + INTERVAL 1 HOUR <= m - INTERVAL 16 MINUTE""", ["power_W", "energy_kWh"]))
def q_stream_demand_hourly(spark, sf_dir):
    return rounded(SD.stream_demand(spark, f"{sf_dir}/events.parquet", AS_OF, _EVENTS_SCHEMA, size="1 hour"))


REPORT_SLICES = 20
REPORT_FILE_ROWS = 200_000


def _stage_ordered_reports(spark, sf_dir) -> tuple[str, int]:
    """Two reports of every session, staged in ``REPORT_SLICES`` ordered slices by the time of the report.

    The first comes half way, with half the energy; of every thirteenth session
    it comes a slice late, after the final report.  A session that cleaning
    drops in the end still had load by its first report.  The reports are dealt
    out once, and the slices are then written in their order.  Gives the folder
    and the number of files of a slice, which grows with the input.
    """
    stage, dealt = scratch_path(spark, "ordered-reports"), scratch_path(spark, "dealt-reports")
    r = raw(spark, sf_dir)
    half = F.timestamp_add("SECOND", F.floor(F.timestamp_diff("SECOND", F.col("startChargeTime"),
                                                              F.col("lastUpdate")) / 2).cast("long"),
                           F.col("startChargeTime"))
    first = r.withColumns({"lastUpdate": half, "cumEnergy_Wh": F.floor(F.col("cumEnergy_Wh") / 2) + 1.0})
    late = F.when(F.col("dcosId") % 13 == 0, 1).otherwise(0)
    reports = first.withColumn("_late", late).unionByName(r.withColumn("_late", F.lit(0)))
    span = r.agg(F.min("startChargeTime").alias("lo"), F.max("lastUpdate").alias("hi"), F.count("*").alias("n")).first()
    width = ((span.hi - span.lo).total_seconds() if span.lo else 0) / REPORT_SLICES + 1
    place = F.floor(F.timestamp_diff("SECOND", as_ntz(span.lo), F.col("lastUpdate")) / width) + F.col("_late")
    (reports.withColumn("slice", place.cast("int")).drop("_late").filter(F.col("slice").between(0, REPORT_SLICES))
     .write.partitionBy("slice").parquet(dealt))
    files = math.ceil(max(1, 2 * span.n) / REPORT_SLICES / REPORT_FILE_ROWS)
    there = TB.subfolders(spark, dealt)
    for k in range(REPORT_SLICES + 1):
        part = [f"{dealt}/slice={k}"] if f"slice={k}" in there else []
        rows = spark.read.schema(r.schema).parquet(*part) if part else r.limit(0)
        rows.coalesce(files).write.mode("append").parquet(stage)
    TB.remove_path(spark, dealt)
    return stage, files


@register("stream_demand_incremental", O.rounded(O.with_ctes(*O.BASE, O.DEMAND_5MIN) + " SELECT * FROM demand_5min",
                                                 O.DEMAND_DOUBLES))
def q_stream_demand_incremental(spark, sf_dir):
    """Many batches of reports, re-reports and late rows: the curve of the final sessions."""
    from loadcurve.schemas import SESSIONS_RAW
    stage, files = _stage_ordered_reports(spark, sf_dir)   # a slice is a batch, however many files it has
    changes = LC.run_demand_changes(spark, file_stream(spark, stage, SESSIONS_RAW, max_files_per_trigger=files))
    return rounded(R.demand_features(LC.demand_curve(spark.read.parquet(changes), AS_OF)))


def _stage_reports(spark, sf_dir) -> tuple[str, int]:
    """Two reports of every session: a partial one (half way), then the final one.

    Gives the folder and the number of files of the first round.
    """
    stage = scratch_path(spark, "session-reports")
    r = raw(spark, sf_dir)
    half = F.timestamp_add("SECOND", F.floor(F.timestamp_diff("SECOND", F.col("startChargeTime"),
                                                              F.col("lastUpdate")) / 2).cast("long"),
                           F.col("startChargeTime"))
    r.withColumn("lastUpdate", half).write.mode("append").parquet(stage)
    files = TB.data_files(spark, stage)
    r.write.mode("append").parquet(stage)
    return stage, files


@register("stream_session_upsert", O.rounded(O.with_ctes(O.SESSIONS_RAW) + " SELECT * FROM sessions_raw",
                                             ["DurationHrs", "cumEnergy_Wh", "peakPower_W"]))
def q_stream_session_upsert(spark, sf_dir):
    from loadcurve.schemas import SESSIONS_RAW
    stage, files = _stage_reports(spark, sf_dir)   # a round is a batch, however many files it has
    target = SU.run_upsert_stream(spark, file_stream(spark, stage, SESSIONS_RAW, max_files_per_trigger=files))
    return rounded(spark.read.schema(SESSIONS_RAW).parquet(target).select(*SESSIONS_RAW.fieldNames()))


def _stage_moving_reports(spark, sf_dir) -> tuple[str, int]:
    """Two ordered rounds of reports: first ones, half way and for every seventeenth session connected a day
    earlier, of two sessions in three; then the final ones of all.  Gives the folder and the first round's files."""
    stage = scratch_path(spark, "moving-reports")
    r = raw(spark, sf_dir)
    half = F.timestamp_add("SECOND", F.floor(F.timestamp_diff("SECOND", F.col("startChargeTime"),
                                                              F.col("lastUpdate")) / 2).cast("long"),
                           F.col("startChargeTime"))
    moved = F.timestamp_add("DAY", F.when(F.col("dcosId") % 17 == 0, -1).otherwise(0), F.col("connectTime"))
    (r.filter(F.col("dcosId") % 3 != 0).withColumns({"lastUpdate": half, "connectTime": moved})
     .write.mode("append").parquet(stage))
    files = TB.data_files(spark, stage)
    r.write.mode("append").parquet(stage)
    return stage, files


@register("refresh_by_change", O.rounded(
    O.with_ctes(*O.BASE, O.DEMAND_5MIN, O.DEMAND_HOURLY, O.DEMAND_DAILY, O.DEMAND_MONTHLY)
    + " UNION ALL ".join(f" SELECT '{t}' AS name, * FROM {t}"
                         for t in ("demand_5min", "demand_hourly", "demand_daily", "demand_monthly")),
    O.DEMAND_DOUBLES))
def q_refresh_by_change(spark, sf_dir):
    """Demand tables kept up to date by the change sets of upserted batches, one of them replayed."""
    from loadcurve.schemas import SESSIONS_RAW
    root, target = scratch_path(spark, "kept-tables"), scratch_path(spark, "sessions-upsert")

    def after(epoch):
        as_of = AS_OF - dt.timedelta(days=max(0, 2 - epoch))
        for _ in range(2):   # the second time is a replay
            INC.refresh_changed(spark, root, SU.change_set(spark, target, epoch), epoch, as_of)

    stage, files = _stage_moving_reports(spark, sf_dir)   # a round is a batch, however many files it has
    reports = file_stream(spark, stage, SESSIONS_RAW, max_files_per_trigger=files)
    SU.run_upsert_stream(spark, reports, target, after=after)
    last = max(int(f.split("=")[1]) for f in TB.subfolders(spark, f"{target}-changes"))
    none = SU.change_set(spark, target, last).limit(0)
    INC.refresh_changed(spark, root, none, last + 1, AS_OF)   # time goes on without reports
    tables = [INC.read_demand(spark, root, name).select(F.lit(name).alias("name"), "*") for name in INC.GRAINS]
    return rounded(functools.reduce(DataFrame.unionByName, tables))


@register("stream_charger_state", O.rounded(O.with_ctes(*O.BASE) + """,
  l AS (SELECT stationId, dcosId, lastUpdate, true_peakPower_W AS currentChargingRate,
               row_number() OVER (PARTITION BY stationId ORDER BY lastUpdate DESC, dcosId) AS rn
        FROM sessions WHERE stationId IS NOT NULL),
  m AS (SELECT max(lastUpdate) AS mx FROM sessions)
  SELECT stationId, dcosId, lastUpdate, currentChargingRate,
         CASE WHEN lastUpdate + INTERVAL 16 MINUTE < mx THEN 'IDLE' ELSE 'IN USE' END AS state
  FROM l, m WHERE rn = 1""", ["currentChargingRate"]))
def q_stream_charger_state(spark, sf_dir):
    ev = file_stream(spark, f"{sf_dir}/events.parquet", _EVENTS_SCHEMA)
    cleaned = C.clean_sessions(FX.sessions_from_events(ev))
    out = SCS.run_charger_state(spark, cleaned, state_partitions=STATE_PARTITIONS)
    # the watermark (newest report - 16 min) passes the last report of a station that is idle
    state = SCS.current_state(spark.read.parquet(out))
    return rounded(state.withColumn("lastUpdate", F.col("lastUpdate").cast("timestamp_ntz")))


@register("stream_charger_newest", O.rounded(O.with_ctes(*O.BASE) + """,
  l AS (SELECT stationId, dcosId, lastUpdate, true_peakPower_W AS currentChargingRate, choice, vehicle_model,
               row_number() OVER (PARTITION BY stationId ORDER BY lastUpdate DESC, dcosId) AS rn
        FROM sessions WHERE stationId IS NOT NULL),
  m AS (SELECT max(lastUpdate) AS mx FROM sessions)
  SELECT stationId, dcosId, lastUpdate, currentChargingRate, choice, vehicle_model,
         CASE WHEN lastUpdate + INTERVAL 16 MINUTE < mx THEN 'IDLE' ELSE 'IN USE' END AS state
  FROM l, m WHERE rn = 1""", ["currentChargingRate"]))
def q_stream_charger_newest(spark, sf_dir):
    """The stations' newest reports over many batches, by grouped maxima of the micro-batches alone."""
    from loadcurve.schemas import SESSIONS_RAW
    stage, _ = _stage_reports(spark, sf_dir)
    reports = file_stream(spark, stage, SESSIONS_RAW, max_files_per_trigger=1)
    path = SCS.run_newest_reports(spark, C.clean_sessions(reports))
    return rounded(SCS.newest_state(spark, path))


# ---- coverage additions: card text (F25), forecast scores (M9), parameter table (S6, M4) --------

@register("kpi_card_text", O.with_ctes(*O.BASE) + f""",
  k AS (SELECT count(*) AS n,
               count(*) FILTER (WHERE choice = 'REGULAR') / nullif(count(*), 0) AS reg,
               count(*) FILTER (WHERE choice = 'SCHEDULED') / nullif(count(*), 0) AS sch,
               coalesce(sum(cumEnergy_Wh), 0) AS wh FROM sessions)
  SELECT format('{{:,.1f}}', round_even(wh / 1000, 1)) || ' kWh' AS cum_kwh_text,
         format('{{:,}}', n) AS cum_sessions_text,
         printf('%.1f%%', round_even(reg * 100, 1)) AS regular_pct_text,
         printf('%.1f%%', round_even(sch * 100, 1)) AS scheduled_pct_text,
         format('{{:,.0f}}', round_even(wh / 290.0, 0)) || ' Mi' AS emiles_text,
         printf('%.1f', round_even(wh / 1000 / 10649.0, 1)) AS home_years_text,
         printf('%.1f', round_even(wh / 290.0 / 5810.0, 1)) AS round_trips_text,
         printf('%.1f', round_even(n / {float(_WEEKS)}, 1)) AS sessions_per_week_text,
         strftime({O.AS_OF}, '%A, %B %d, %Y') AS date_title
  FROM k""")
def q_kpi_card_text(spark, sf_dir):
    return K.card_text(K.kpi_cumulative(C.session_subset(sessions(spark, sf_dir)), AS_OF), AS_OF)


@register("forecast_scores", O.rounded(O.with_ctes(O.HOURLY_SERIES, O.RUNS) + """
  SELECT count(*) AS n, sqrt(avg((f.avg_power_demand_kW_predictions - a.v) * (f.avg_power_demand_kW_predictions - a.v)))
           AS rmse,
         avg(abs(f.avg_power_demand_kW_predictions - a.v)) AS mae
  FROM hourly_series a JOIN upserted f ON f.time = a.time
  WHERE a.time >= TIMESTAMP '2024-01-10' AND f.avg_power_demand_kW_predictions IS NOT NULL""", ["rmse", "mae"]))
def q_forecast_scores(spark, sf_dir):
    existing, new = _runs(spark, sf_dir)
    fc = FC.upsert_forecasts(existing, new, "hour")
    actual = FX.hourly_series(spark, sf_dir).select("time", F.col("v").alias("avg_power_demand_kW"))
    return rounded(FC.forecast_scores(FC.actual_vs_forecast(actual, fc, "avg_power_demand_kW", "2024-01-10")))


@register("knn_params", _SCORES_SQL + """,
  best AS (SELECT CAST(depth AS INTEGER) AS best_depth, CAST(k AS INTEGER) AS best_n_neighbors
           FROM scores ORDER BY mse, k, depth LIMIT 1)
  SELECT 'knn' AS model, 'hourly' AS series, q.quantity, best_depth, best_n_neighbors
  FROM best, (VALUES ('energy_demand_kWh'), ('avg_power_demand_kW')) q(quantity)""")
def q_knn_params(spark, sf_dir):
    best = KN.knn_grid_search(FX.hourly_series(spark, sf_dir).select("time", "v"), GRID_DEPTHS, GRID_KS,
                                       period=GRID_PERIOD)
    params = KN.params_table(best, "knn", "hourly", "energy_demand_kWh",
                             same_as={"avg_power_demand_kW": "energy_demand_kWh"})
    root = scratch_path(spark, "params")
    TB.save_params(params, root)
    return TB.load_params(spark, root, "knn", "hourly")


# ---- keyed forms (many series in one job) -------------------------------------------------------

@register("demand_hourly_by_station", O.rounded(O.with_ctes(*O.BASE) + f""",
  kslots AS (SELECT stationId, slot, w FROM (
               SELECT stationId, unnest(generate_series({O.LO}, {O.HI})) AS slot, true_peakPower_W AS w
               FROM sessions WHERE {O.LO} <= {O.HI}) WHERE slot <= {O.END_IDX}),
  ksums AS (SELECT stationId, slot, sum(w) AS w FROM kslots GROUP BY stationId, slot),
  kspine AS (SELECT stationId, unnest(generate_series(lo, {O.END_IDX})) AS slot
             FROM (SELECT stationId, min(slot) AS lo FROM ksums GROUP BY stationId)),
  k5 AS (SELECT sp.stationId, {O.slot_ts('sp.slot')} AS time, coalesce(s.w, 0) AS w
         FROM kspine sp LEFT JOIN ksums s ON s.stationId = sp.stationId AND s.slot = sp.slot)
  SELECT stationId, date_trunc('hour', time) AS time, avg(w / 1000) AS avg_power_demand_kW,
         sum((w / 1000) / 12) AS energy_demand_kWh, max(w / 1000) AS peak_power_kW,
         dayname(min(time)) AS day, monthname(min(time)) AS month
  FROM k5 GROUP BY stationId, date_trunc('hour', time)""", O.DEMAND_DOUBLES))
def q_demand_hourly_by_station(spark, sf_dir):
    by = ["stationId"]
    return rounded(R.rollup(R.demand_5min(sessions(spark, sf_dir), AS_OF, by), "hour", by))


@register("charger_status_all_sites", O.rounded(O.with_ctes(*O.BASE) + f""",
  cx AS (SELECT *, (epoch_us({O.AS_OF}) - epoch_us(lastUpdate)) <= 960000000 AS fresh,
                finishChargeTime >= {O.TODAY} AS today
         FROM sessions WHERE stationId IS NOT NULL),
  cur AS (SELECT * EXCLUDE (rn) FROM (
            SELECT siteId AS site, stationId AS sid, true_peakPower_W AS currentChargingRate, choice, vehicle_model,
                   CAST(sch_centsPerHr AS DOUBLE) AS sch_centsPerHr, CAST(reg_centsPerHr AS DOUBLE) AS reg_centsPerHr,
                   row_number() OVER (PARTITION BY siteId, stationId ORDER BY lastUpdate DESC, dcosId) AS rn
            FROM cx WHERE fresh) WHERE rn = 1),
  cagg AS (SELECT siteId, stationId, max(CASE WHEN fresh THEN 1 ELSE 0 END) AS in_use,
                  coalesce(sum(cumEnergy_Wh), 0) AS cumEnergy_Wh,
                  coalesce(sum(CASE WHEN today THEN cumEnergy_Wh END), 0) AS todayEnergy_Wh,
                  coalesce(sum(CASE WHEN today THEN DurationHrs END), 0) AS today_h
           FROM cx GROUP BY siteId, stationId)
  SELECT a.siteId, a.stationId, CAST(a.in_use AS INTEGER) AS inUse, c.currentChargingRate, c.choice,
         c.vehicle_model, c.sch_centsPerHr, c.reg_centsPerHr, a.cumEnergy_Wh, a.todayEnergy_Wh,
         a.todayEnergy_Wh / (6600.0 * 24) AS currPowerUtilRate, a.today_h / 24 AS currOccupUtilRate,
         CASE WHEN a.in_use = 1 THEN 'IN USE' ELSE 'IDLE' END AS state
  FROM cagg a LEFT JOIN cur c ON c.site = a.siteId AND c.sid = a.stationId""", _CHARGER_DOUBLES))
def q_charger_status_all_sites(spark, sf_dir):
    return rounded(ST.charger_status(sessions(spark, sf_dir), AS_OF, site=None, by=["siteId"]))


# ---- forecasts by stored parameters, keyed search, backtest, users over a range -------------------

# no k that is a power of two: means that end in a half at the sixth digit round differently in two engines
JOB_PARAMS = {(25, "avg_power_demand_kW"): (3, 7), (25, "energy_demand_kWh"): (5, 7), (25, "peak_power_kW"): (2, 11),
              (99, "avg_power_demand_kW"): (6, 3), (99, "energy_demand_kWh"): (1, 9), (99, "peak_power_kW"): (4, 5)}

_SITE_HOURLY = f"""
  kslots AS (SELECT siteId, slot, w FROM (
               SELECT siteId, unnest(generate_series({O.LO}, {O.HI})) AS slot, true_peakPower_W AS w
               FROM sessions WHERE {O.LO} <= {O.HI}) WHERE slot <= {O.END_IDX}),
  ksums AS (SELECT siteId, slot, sum(w) AS w FROM kslots GROUP BY siteId, slot),
  kspine AS (SELECT siteId, unnest(generate_series(lo, {O.END_IDX})) AS slot
             FROM (SELECT siteId, min(slot) AS lo FROM ksums GROUP BY siteId)),
  k5 AS (SELECT sp.siteId, {O.slot_ts('sp.slot')} AS time, coalesce(s.w, 0) AS w
         FROM kspine sp LEFT JOIN ksums s ON s.siteId = sp.siteId AND s.slot = sp.slot),
  kh AS (SELECT siteId, date_trunc('hour', time) AS time, avg(w / 1000) AS avg_power_demand_kW,
                sum((w / 1000) / 12) AS energy_demand_kWh, max(w / 1000) AS peak_power_kW
         FROM k5 GROUP BY siteId, date_trunc('hour', time))"""


def _one_forecast_sql(name: str, site: int, quantity: str, depth: int, k: int) -> str:
    return f"""
  {name}_e AS (SELECT time, {quantity} AS v, false AS fut FROM kh WHERE siteId = {site}
               UNION ALL SELECT (SELECT max(time) FROM kh WHERE siteId = {site}) + to_hours(h), 0.0, true
               FROM range(1, 25) r(h)),
  {name}_f AS (SELECT * FROM (SELECT *, {O.lag_cols(depth)} FROM {name}_e) WHERE {O.lags_not_null(depth)}),
  {name}_p AS (SELECT q.time AS q_time, t.v AS t_y, row_number() OVER (PARTITION BY q.time ORDER BY {O.dist(depth)}, t.time)
                 AS rk FROM {name}_f q, {name}_f t WHERE q.fut AND NOT t.fut),
  {name} AS (SELECT {site} AS siteId, '{quantity}' AS quantity, q_time AS time, avg(t_y) AS v
             FROM {name}_p WHERE rk <= {k} GROUP BY q_time)"""


_JOB_SQL = O.with_ctes(*O.BASE, _SITE_HOURLY, *[
    _one_forecast_sql(f"p{i}", site, q, d, k) for i, ((site, q), (d, k)) in enumerate(JOB_PARAMS.items())]) + """,
  al AS (""" + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(len(JOB_PARAMS))) + """)
  SELECT CAST(siteId AS INTEGER) AS siteId, time, """ + ", ".join(
    f"CASE WHEN hour(time) <= 5 THEN 0.0 ELSE greatest(0.0, max(v) FILTER (WHERE quantity = '{q}')) END AS {q}_predictions"
    for q in ("avg_power_demand_kW", "energy_demand_kWh", "peak_power_kW")) + " FROM al GROUP BY siteId, time"


@register("forecast_job_hourly", O.rounded(_JOB_SQL, O.PRED_COLS))
def q_forecast_job_hourly(spark, sf_dir):
    """The hourly forecast job over two sites' stored demand, each quantity by its own stored depth and k."""
    root, by = scratch_path(spark, "forecast-job"), ["siteId"]
    TB.write_table(R.rollup(R.demand_5min(sessions(spark, sf_dir), AS_OF, by), "hour", by), "demand_hourly", root)
    stored = [("knn", "hourly", site, q, d, k) for (site, q), (d, k) in JOB_PARAMS.items()]
    TB.save_params(spark.createDataFrame(stored, "model string, series string, siteId int, quantity string, "
                                                 "best_depth int, best_n_neighbors int"), root, by=by)
    return rounded(JOBS.forecast_hourly(spark, root, by=by))


def _keyed_daily(spark, sf_dir) -> DataFrame:
    """Daily order totals of even and odd customers, from the first to the last day of all orders."""
    o = FX.table(spark, sf_dir, "orders").filter("o_orderdate is not null").select(
        (F.col("o_custkey") % 2).cast("int").alias("side"), F.col("o_orderdate").cast("timestamp_ntz").alias("time"),
        F.col("o_totalprice").alias("value"))
    ends = o.agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    spine = regular_spine(ends, "lo", "hi", 86400).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "time",
                                                          F.lit(0.0).alias("value"))
    return spine.unionByName(o).groupBy("side", "time").agg(F.sum("value").alias("v"))


KEYED_DEPTHS, KEYED_PERIOD = list(range(40, 61)), 24


@register("knn_grid_keyed", O.rounded("""
WITH ends AS (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders),
  sp AS (SELECT side, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS time FROM ends, (VALUES (0), (1)) s(side)),
  ks AS (SELECT sp.side, sp.time, coalesce(sum(o_totalprice), 0) AS v FROM sp
         LEFT JOIN orders o ON o.o_orderdate = sp.time AND o.o_custkey % 2 = sp.side GROUP BY ALL),
  f AS (SELECT * FROM (SELECT *, """ + ", ".join(
      f"lag(v, {KEYED_PERIOD * k}) OVER (PARTITION BY side ORDER BY time) AS lag{k}" for k in range(1, 61)) + f""" FROM ks)
        WHERE {O.lags_not_null(60)}),
  s AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY time) AS rn, count(*) OVER (PARTITION BY side) AS n FROM f),
  sl AS (SELECT *, {O.split_case()} AS split FROM s),
  q AS (SELECT * FROM sl WHERE split = 'validation'),
  t AS (SELECT * FROM sl WHERE split = 'train'),
  pd AS (""" + " UNION ALL ".join(
      f"SELECT q.side, q.time AS q_time, q.v AS q_y, t.time AS t_time, t.v AS t_y, {d} AS depth, {O.dist(d)} AS d "
      f"FROM q JOIN t ON t.side = q.side" for d in KEYED_DEPTHS) + """),
  r AS (SELECT *, row_number() OVER (PARTITION BY side, q_time, depth ORDER BY d, t_time) AS k FROM pd
        QUALIFY k <= 25),
  r2 AS (SELECT *, avg(t_y) OVER (PARTITION BY side, q_time, depth ORDER BY k ROWS UNBOUNDED PRECEDING) AS pred FROM r)
SELECT CAST(side AS INTEGER) AS side, CAST(depth AS INTEGER) AS depth, CAST(k AS INTEGER) AS k,
       sqrt(avg((pred - q_y) * (pred - q_y))) AS rmse
FROM r2 WHERE k >= 10 GROUP BY side, depth, k""", ["rmse"], 3))
def q_knn_grid_keyed(spark, sf_dir):
    """All 336 pairs over lags 24 rows apart on the whole span of daily orders, two series in one job."""
    scores = KN.knn_grid_scores(_keyed_daily(spark, sf_dir), KEYED_DEPTHS, KNN_KS, by=["side"], period=KEYED_PERIOD)
    return rounded(scores.select("side", "depth", "k", F.sqrt("mse").alias("rmse")), 3)


BACKTEST_ORIGINS = 6


@register("knn_backtest", O.rounded(_HS + f""",
  o AS (SELECT max(time) - to_hours(24 * b) AS origin FROM hourly_series, range(1, {BACKTEST_ORIGINS + 1}) r(b) GROUP BY b),
  e AS (SELECT origin, time, v, false AS fut FROM o, hourly_series WHERE time <= origin
        UNION ALL SELECT origin, origin + to_hours(h), 0.0, true FROM o, range(1, 25) r(h)),
  f AS (SELECT * FROM (SELECT *, {", ".join(f"lag(v, {24 * k}) OVER (PARTITION BY origin ORDER BY time) AS lag{k}"
                                            for k in range(1, KNN_DEPTH + 1))} FROM e) WHERE {O.lags_not_null(KNN_DEPTH)}),
  p AS (SELECT q.origin, q.time, t.v AS y, row_number() OVER (PARTITION BY q.origin, q.time ORDER BY {O.dist(KNN_DEPTH)}, t.time)
          AS rk FROM f q JOIN f t ON t.origin = q.origin AND q.fut AND NOT t.fut),
  m AS (SELECT origin, time, avg(y) AS pred FROM p WHERE rk <= {KNN_K} GROUP BY origin, time)
  SELECT CAST(datediff('hour', origin, m.time) AS INTEGER) AS horizon, count(*) AS n,
         sqrt(avg((pred - v) * (pred - v))) AS rmse, avg(abs(pred - v)) AS mae
  FROM m JOIN hourly_series h ON h.time = m.time GROUP BY 1""", ["rmse", "mae"]))
def q_knn_backtest(spark, sf_dir):
    """Errors by horizon over rolling origins of the hourly series, all origins forecast in one job."""
    series = FX.hourly_series(spark, sf_dir).select("time", "v")
    preds = KN.knn_forecast(FC.rolling_origins(series, BACKTEST_ORIGINS), KNN_DEPTH, KNN_K, by=["origin"])
    return rounded(FC.scores_by_horizon(preds, series))


@register("users_in_range", O.with_ctes(*O.BASE) + """
  SELECT siteId, count(DISTINCT userId) AS users, true AS sketch_within_5_percent FROM sessions
  WHERE userId IS NOT NULL AND connectTime >= TIMESTAMP '2024-01-05' AND connectTime < TIMESTAMP '2024-01-20'
  GROUP BY siteId""")
def q_users_in_range(spark, sf_dir):
    """Distinct users of two weeks per site: the exact count, and whether the merged day sketches come within 5 %."""
    s, by = sessions(spark, sf_dir), ["siteId"]
    root = scratch_path(spark, "user-sketches")
    TB.write_table(K.daily_user_sketches(s, by), "user_sketches", root, ["day"])
    guess = K.users_between(TB.read_table(spark, "user_sketches", root), "2024-01-05", "2024-01-19", by)
    exact = (s.filter((F.col("connectTime") >= as_ntz("2024-01-05")) & (F.col("connectTime") < as_ntz("2024-01-20")))
             .groupBy(*by).agg(F.countDistinct("userId").alias("users")).filter("users > 0"))
    return exact.join(guess.withColumnRenamed("users", "_guess"), by, "left").select(
        *by, "users", (F.abs(F.col("_guess") - F.col("users")) <= 0.05 * F.col("users")).alias("sketch_within_5_percent"))
