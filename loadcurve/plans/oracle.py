"""DuckDB oracle SQL for the registered queries.

independently of the Spark plan, over the driver's views (``events``,
``orders``, ...).  Doubles are rounded half-to-even to 6 digits on both
sides.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-30 12:00:00'"
TODAY = "TIMESTAMP '2024-01-30 00:00:00'"
YESTERDAY = "TIMESTAMP '2024-01-29 00:00:00'"
US = "epoch_us"

SESSIONS_RAW = f"""
sessions_raw AS (
  SELECT event_id AS dcosId,
         CAST(user_id AS VARCHAR) AS userId,
         CAST(CASE WHEN event_id % 10 = 0 THEN 99 ELSE 25 END AS INTEGER) AS siteId,
         CAST(event_id % 8 + 1 AS BIGINT) AS stationId,
         date_trunc('second', ts) - INTERVAL 2 MINUTE AS connectTime,
         date_trunc('second', ts) AS startChargeTime,
         CASE WHEN event_id % 47 = 0 THEN NULL
              ELSE date_trunc('second', ts) + to_hours(CAST(1 + event_id % 12 AS BIGINT)) END AS Deadline,
         date_trunc('second', ts) + to_seconds(CAST(floor(value * 180) AS BIGINT)) AS lastUpdate,
         printf('%d days %02d:%02d:%02d',
                CAST(floor(value * 180) AS BIGINT) // 86400,
                (CAST(floor(value * 180) AS BIGINT) % 86400) // 3600,
                (CAST(floor(value * 180) AS BIGINT) % 3600) // 60,
                CAST(floor(value * 180) AS BIGINT) % 60) AS Duration,
         value / 20 AS DurationHrs,
         CASE WHEN event_id % 50 = 0 THEN CAST(0 AS DOUBLE)
              WHEN event_id % 53 = 0 THEN CAST(NULL AS DOUBLE)
              ELSE CAST((event_id * 37) % 40000 + 500 AS DOUBLE) END AS cumEnergy_Wh,
         CASE WHEN event_id % 61 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(6600 AS DOUBLE) END AS peakPower_W,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'SCHEDULED' ELSE 'REGULAR' END AS choice,
         CASE WHEN event_id % 59 = 0 THEN NULL ELSE 'model_' || CAST(user_id % 25 AS VARCHAR) END AS vehicle_model,
         CAST(100 + 10 * (event_id % 5) AS BIGINT) AS sch_centsPerHr,
         CAST(150 + 10 * (event_id % 7) AS BIGINT) AS reg_centsPerHr,
         'u' || CAST(user_id AS VARCHAR) || '@example.org' AS user_email,
         event_id AS paymentId
  FROM events
)"""


def _cleaned(name: str, source: str, day_filter: str, extra_where: str = "") -> str:
    return f"""
{name} AS (
  SELECT * EXCLUDE (user_email, paymentId, _ov),
         lastUpdate AS finishChargeTime,
         round_even(cumEnergy_Wh / nullif(DurationHrs, 0), 0) AS true_peakPower_W,
         CAST(_ov // 1000000 AS BIGINT) AS Overstay_s,
         ((_ov // 1000000) % 86400) / 3600.0 AS Overstay_h,
         _ov / 3600000000.0 AS Overstay_total_h
  FROM (SELECT *, greatest(coalesce(epoch_us(lastUpdate) - epoch_us(Deadline), 0), 0) AS _ov FROM {source})
  WHERE peakPower_W IS DISTINCT FROM 0 AND cumEnergy_Wh IS DISTINCT FROM 0
    AND DurationHrs <= 24 AND {day_filter} {extra_where}
)"""


SESSIONS = _cleaned("sessions", "sessions_raw",
                    r"TRY_CAST(regexp_extract(Duration, '(\d{1,2}) days', 1) AS INTEGER) <= 2")
TODAY_SESSIONS = _cleaned("today_clean", "sessions_raw",
                          "TRY_CAST(substr(Duration, 1, 1) AS INTEGER) <= 1",
                          f"AND lastUpdate >= {TODAY}")

# slot index helpers (5-minute steps, half-to-even rounding)
LO = "CAST(round_even(epoch_us(startChargeTime) / 300000000.0, 0) AS BIGINT)"
HI = "CAST(round_even(epoch_us(finishChargeTime) / 300000000.0, 0) AS BIGINT)"
END_IDX = f"CAST(floor(epoch_us({AS_OF}) / 300000000.0) AS BIGINT)"


def slot_ts(idx: str) -> str:
    return f"(TIMESTAMP '1970-01-01' + to_microseconds(CAST({idx} AS BIGINT) * 300000000))"


DEMAND_5MIN = f"""
slots AS (
  SELECT slot, w FROM (
    SELECT unnest(generate_series({LO}, {HI})) AS slot, true_peakPower_W AS w
    FROM sessions WHERE {LO} <= {HI})
  WHERE slot <= {END_IDX}
),
spine AS (
  SELECT unnest(generate_series(lo, {END_IDX})) AS slot, CAST(0 AS DOUBLE) AS w
  FROM (SELECT min({LO}) AS lo FROM sessions WHERE {LO} <= {HI}) WHERE lo <= {END_IDX}
),
watts AS (
  SELECT slot, coalesce(sum(w), 0) AS w FROM (SELECT * FROM spine UNION ALL SELECT * FROM slots) GROUP BY slot
),
demand_5min AS (
  SELECT {slot_ts('slot')} AS time,
         w / 1000 AS avg_power_demand_kW,
         (w / 1000) / 12 AS energy_demand_kWh,
         w / 1000 AS peak_power_kW,
         dayname({slot_ts('slot')}) AS day,
         monthname({slot_ts('slot')}) AS month
  FROM watts
)"""


def rollup_sql(name: str, key: str) -> str:
    return f"""
{name} AS (
  SELECT {key} AS time,
         avg(avg_power_demand_kW) AS avg_power_demand_kW,
         sum(energy_demand_kWh) AS energy_demand_kWh,
         max(peak_power_kW) AS peak_power_kW,
         arg_min(day, time) AS day,
         arg_min(month, time) AS month
  FROM demand_5min GROUP BY 1
)"""


DEMAND_HOURLY = rollup_sql("demand_hourly", "date_trunc('hour', time)")
DEMAND_DAILY = rollup_sql("demand_daily", "date_trunc('day', time)")
DEMAND_MONTHLY = rollup_sql("demand_monthly", "CAST(last_day(time) AS TIMESTAMP)")


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def rounded(sql: str, cols: list[str], digits: int = 6) -> str:
    """Wrap a query so the listed double columns are rounded half-to-even."""
    if not cols:
        return sql
    rep = ", ".join(f"round_even({c}, {digits}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS q"


DEMAND_DOUBLES = ["avg_power_demand_kW", "energy_demand_kWh", "peak_power_kW"]
SESSION_DOUBLES = ["DurationHrs", "cumEnergy_Wh", "peakPower_W", "true_peakPower_W",
                   "Overstay_h", "Overstay_total_h"]

BASE = [SESSIONS_RAW, SESSIONS]


# ---- step 2-4 building blocks -------------------------------------------------------

TODAY_SLOTS = f"""
today_rows AS (
  SELECT * EXCLUDE (slot), {slot_ts('slot')} AS Time, true_peakPower_W AS Power_W FROM (
    SELECT *, unnest(generate_series({LO}, {HI})) AS slot FROM today_clean WHERE {LO} <= {HI})
  WHERE slot <= {END_IDX} AND {slot_ts('slot')} >= {TODAY}
)"""

TODAY_BASE = [SESSIONS_RAW, TODAY_SESSIONS, TODAY_SLOTS]

PART_OF_DAY = """CASE WHEN hour(connectTime) BETWEEN 6 AND 10 THEN 'Morning! 🐦'
            WHEN hour(connectTime) BETWEEN 11 AND 16 THEN 'Afternoon! ☀️'
            WHEN hour(connectTime) BETWEEN 17 AND 22 THEN 'Evening! 🌙'
            ELSE 'Really late at night! 🦉' END"""


def pct_change(a: str, b: str) -> str:
    return (f"CASE WHEN coalesce({a}, 0) = 0 AND coalesce({b}, 0) = 0 THEN 0.0 "
            f"WHEN coalesce({b}, 0) = 0 THEN 100.0 ELSE ({a} - {b}) * 100.0 / {b} END")


def direction(c: str) -> str:
    return f"CASE WHEN {c} > 0 THEN 'up' WHEN {c} < 0 THEN 'down' ELSE 'same' END"


CHARGERS = f"""
cx AS (
  SELECT *, (epoch_us({AS_OF}) - epoch_us(lastUpdate)) <= 960000000 AS fresh,
         finishChargeTime >= {TODAY} AS today
  FROM sessions WHERE siteId = 25 AND stationId IS NOT NULL
),
cur AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT stationId AS sid, true_peakPower_W AS currentChargingRate, choice, vehicle_model,
           CAST(sch_centsPerHr AS DOUBLE) AS sch_centsPerHr, CAST(reg_centsPerHr AS DOUBLE) AS reg_centsPerHr,
           row_number() OVER (PARTITION BY stationId ORDER BY lastUpdate DESC, dcosId) AS rn
    FROM cx WHERE fresh) WHERE rn = 1
),
cagg AS (
  SELECT stationId, coalesce(sum(cumEnergy_Wh), 0) AS cumEnergy_Wh,
         coalesce(sum(CASE WHEN today THEN cumEnergy_Wh END), 0) AS todayEnergy_Wh,
         coalesce(sum(CASE WHEN today THEN DurationHrs END), 0) AS today_h
  FROM cx GROUP BY stationId
),
chargers AS (
  SELECT a.stationId, CAST(CASE WHEN c.sid IS NULL THEN 0 ELSE 1 END AS INTEGER) AS inUse,
         c.currentChargingRate, c.choice, c.vehicle_model, c.sch_centsPerHr, c.reg_centsPerHr,
         a.cumEnergy_Wh, a.todayEnergy_Wh,
         a.todayEnergy_Wh / (6600.0 * 24) AS currPowerUtilRate, a.today_h / 24 AS currOccupUtilRate,
         CASE WHEN c.sid IS NULL THEN 'IDLE' ELSE 'IN USE' END AS state
  FROM cagg a LEFT JOIN cur c ON c.sid = a.stationId
)"""

DAILY_SERIES = """
daily_series AS (
  SELECT sp.d AS time, coalesce(o.v, 0) AS v
  FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders) sp
  LEFT JOIN (SELECT o_orderdate AS od, sum(o_totalprice) AS v FROM orders GROUP BY 1) o ON o.od = sp.d
)"""

HOURLY_SERIES = """
hourly_series AS (
  SELECT sp.h AS time, CAST(datediff('hour', (SELECT min(ts) FROM events), sp.h) AS BIGINT) AS i, coalesce(e.v, 0) AS v
  FROM (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS h
        FROM events) sp
  LEFT JOIN (SELECT date_trunc('hour', ts) AS h, sum(value) AS v FROM events GROUP BY 1) e ON e.h = sp.h
)"""


# ---- step 6: lags, kNN, forecast tables ------------------------------------------------

def lag_cols(depth: int, src: str = "v", order: str = "time", period: int = 24) -> str:
    return ", ".join(f"lag({src}, {period * k}) OVER (ORDER BY {order}) AS lag{k}" for k in range(1, depth + 1))


def lags_not_null(depth: int, prefix: str = "") -> str:
    return " AND ".join(f"{prefix}lag{k} IS NOT NULL" for k in range(1, depth + 1))


def dist(depth: int) -> str:
    return " + ".join(f"(q.lag{k} - t.lag{k}) * (q.lag{k} - t.lag{k})" for k in range(1, depth + 1))


def split_case(n: str = "n", rn: str = "rn") -> str:
    tv = f"({n} - ceil({n} * 0.2))"
    return (f"CASE WHEN {rn} > {tv} THEN 'test' WHEN {rn} > {tv} - ceil({tv} * 0.2) THEN 'validation' "
            f"ELSE 'train' END")


RUNS = """
e_run AS (
  SELECT time, v AS avg_power_demand_kW_predictions,
         CASE WHEN CAST(floor(v) AS BIGINT) % 5 = 0 THEN NULL ELSE v / 12 END AS energy_demand_kWh_predictions,
         v * 1.5 AS peak_power_kW_predictions
  FROM hourly_series
),
n_run AS (
  SELECT time + INTERVAL 360 HOUR AS time,
         CASE WHEN CAST(floor(v) AS BIGINT) % 7 = 0 THEN NULL ELSE v * 1.1 END AS avg_power_demand_kW_predictions,
         v * 1.1 / 12 AS energy_demand_kWh_predictions,
         CASE WHEN v = 0 THEN NULL ELSE v * 1.6 END AS peak_power_kW_predictions
  FROM hourly_series
),
upserted AS (
  SELECT sp.time,
         coalesce(n.avg_power_demand_kW_predictions, e.avg_power_demand_kW_predictions) AS avg_power_demand_kW_predictions,
         coalesce(n.energy_demand_kWh_predictions, e.energy_demand_kWh_predictions) AS energy_demand_kWh_predictions,
         coalesce(n.peak_power_kW_predictions, e.peak_power_kW_predictions) AS peak_power_kW_predictions
  FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS time
        FROM (SELECT min(time) AS lo, max(time) AS hi FROM (SELECT time FROM e_run UNION ALL SELECT time FROM n_run))) sp
  LEFT JOIN e_run e ON e.time = sp.time LEFT JOIN n_run n ON n.time = sp.time
)"""

PRED_COLS = ["avg_power_demand_kW_predictions", "energy_demand_kWh_predictions", "peak_power_kW_predictions"]
