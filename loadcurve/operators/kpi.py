"""Key-figure cards.

Each card is **one** aggregation -- conditional aggregates over one scan --
so there is neither a join nor a driver round trip.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadcurve.functions.scalars import change_direction, pct_change
from loadcurve.functions.timecols import as_ntz, day_start, floor_time, slot_index
from loadcurve.operators.clean import keep_condition, newest_reports, today_condition, with_helpers
from loadcurve.operators.timegrid import slot_bounds

# Fixed values of the reference's equivalence cards.
KWH_PER_HOME_YEAR = 10649.0
WH_PER_MILE = 290.0
MILES_PER_ROUND_TRIP = 5810.0
SERVICE_START = dt.datetime(2020, 11, 5)


def _slots_between(lo, hi, a, b):
    """Number of slot indices in [lo, hi] ∩ [a, b]."""
    return F.greatest(F.least(hi, b) - F.greatest(lo, a) + 1, F.lit(0))


def kpi_today(raw: DataFrame, as_of, approx_users: bool = False) -> DataFrame:
    """C11: today's kWh, sessions and users, against yesterday.

    One scan of the raw sessions: the "today" cleaning path and the full one
    are two flags over the same rows, and every figure is a conditional
    aggregate.  A session counts today when it has a 5-minute slot between
    midnight and ``floor5(as_of)`` (exactly the rows of ``todays_sessions``).
    Yesterday's kWh equals the daily demand of that day: power x slots on that
    day / 12.
    """
    now = as_ntz(as_of)
    m_idx = slot_index(day_start(now), 300, "floor")
    n_idx = slot_index(floor_time(now, 300), 300, "floor")
    y_idx = m_idx - 288
    lo, hi = slot_bounds("startChargeTime", "finishChargeTime")
    yest_day = F.timestamp_add("DAY", F.lit(-1), day_start(now))
    # every contributing row has a slot since yesterday (so lastUpdate >= yesterday minus
    # half a slot) or connected yesterday: an exact, pushable bound -- a stored table is
    # read for about two days, not for its whole history
    recent = ((F.col("lastUpdate") >= F.timestamp_add("MINUTE", F.lit(-5), yest_day))
              | ((F.col("connectTime") >= yest_day) & (F.col("connectTime") < day_start(now))))
    rows = with_helpers(newest_reports(raw.filter(recent), F.col("cumEnergy_Wh").desc())
                           .withColumn("_today", today_condition(as_of))
                           .withColumn("_full", keep_condition())
                           .filter(F.col("_today") | F.col("_full")))
    today = F.col("_today") & (_slots_between(lo, hi, m_idx, n_idx) > 0)
    full = F.col("_full")
    y_energy = (F.coalesce(F.col("true_peakPower_W"), F.lit(0.0))
                * _slots_between(lo, hi, y_idx, m_idx - 1) / 12000.0)
    # exact distinct counts by default; the HyperLogLog form avoids the distinct shuffle
    distinct = (lambda c: F.approx_count_distinct(c)) if approx_users else (lambda c: F.countDistinct(c))
    out = rows.agg(
        (F.coalesce(F.sum(F.when(today, F.col("cumEnergy_Wh"))), F.lit(0.0)) / 1000).alias("kwh_today"),
        F.count(F.when(today, F.col("dcosId"))).alias("sessions_today"),
        distinct(F.when(today, F.col("userId"))).alias("users_today"),
        F.coalesce(F.sum(F.when(full, y_energy)), F.lit(0.0)).alias("kwh_yesterday"),
        distinct(F.when(full & (day_start(F.col("connectTime")) == yest_day), F.col("userId")))
         .alias("users_yesterday"))
    return (out.withColumn("kwh_change_pct", pct_change("kwh_today", "kwh_yesterday"))
               .withColumn("kwh_direction", change_direction("kwh_change_pct"))
               .withColumn("users_change", F.col("sessions_today") - F.col("users_yesterday"))
               .withColumn("users_direction", change_direction("users_change")))


def kpi_month_peak(monthly: DataFrame, quantity: str = "peak_power_kW", by=()) -> DataFrame:
    """Last period's value, the one before, and the change in percent."""
    w = Window.partitionBy(*by).orderBy("time")   # months per series: a short list
    last = (monthly.withColumn("_prev", F.lag(quantity).over(w))
                   .withColumn("_rk", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("time").desc())))
                   .filter(F.col("_rk") == 1))
    return (last.select(*by, "time", quantity, F.col("_prev").alias("previous_" + quantity))
                .withColumn("change_pct", pct_change(quantity, "previous_" + quantity))
                .withColumn("direction", change_direction("change_pct")))


def kpi_cumulative(subset: DataFrame, as_of) -> DataFrame:
    """Totals since the start, the REGULAR / SCHEDULED split and equivalents."""
    d = as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(str(as_of))
    weeks = (d - SERVICE_START).days // 7
    out = subset.agg(
        F.count("*").alias("cum_sessions"),
        F.count_if(F.col("choice") == "REGULAR").alias("regular_sessions"),
        F.count_if(F.col("choice") == "SCHEDULED").alias("scheduled_sessions"),
        F.coalesce(F.sum("cumEnergy_Wh"), F.lit(0.0)).alias("_wh"))
    n = F.col("cum_sessions")
    return out.select(
        "cum_sessions", "regular_sessions", "scheduled_sessions",
        F.try_divide(F.col("regular_sessions"), n).alias("regular_share"),
        F.try_divide(F.col("scheduled_sessions"), n).alias("scheduled_share"),
        (F.col("_wh") / 1000).alias("cum_kwh"),
        (F.col("_wh") / 1000 / KWH_PER_HOME_YEAR).alias("home_years"),
        (F.col("_wh") / WH_PER_MILE).alias("emiles"),
        (F.col("_wh") / WH_PER_MILE / MILES_PER_ROUND_TRIP).alias("round_trips"),
        F.lit(weeks).cast("long").alias("weeks"),
        F.try_divide(n.cast("double"), F.lit(float(weeks))).alias("sessions_per_week"))


def card_text(cum: DataFrame, as_of) -> DataFrame:
    """display text of the cumulative cards (numbers stay raw in :func:`kpi_cumulative`).

    Values are rounded half-to-even first, then printed, so the text never
    depends on a formatter's own tie rule.
    """
    d = as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(str(as_of))

    def num(c, digits):
        return F.format_number(F.bround(F.col(c), digits), digits)

    def pct(c):
        return F.format_string("%.1f%%", F.bround(F.col(c) * 100, 1))

    return cum.select(
        F.concat(num("cum_kwh", 1), F.lit(" kWh")).alias("cum_kwh_text"),
        F.format_number(F.col("cum_sessions"), 0).alias("cum_sessions_text"),
        pct("regular_share").alias("regular_pct_text"),
        pct("scheduled_share").alias("scheduled_pct_text"),
        F.concat(num("emiles", 0), F.lit(" Mi")).alias("emiles_text"),
        F.format_string("%.1f", F.bround(F.col("home_years"), 1)).alias("home_years_text"),
        F.format_string("%.1f", F.bround(F.col("round_trips"), 1)).alias("round_trips_text"),
        F.format_string("%.1f", F.bround(F.col("sessions_per_week"), 1)).alias("sessions_per_week_text"),
        F.date_format(F.lit(d.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz"),
                      "EEEE, MMMM dd, yyyy").alias("date_title"))


def _change_text(change: str, number: str, digits: int, since: str):
    """'+12% since ...!', or that nothing changed (null counts as that); rounded half-to-even before it is printed."""
    value = F.bround(F.col(change).cast("double"), digits)
    return F.when(F.coalesce(F.col(change).cast("double"), F.lit(0.0)) == 0, f"No change since {since}!").otherwise(
        F.concat(F.format_string(number, value), F.lit(f" since {since}!")))


def today_card_text(today: DataFrame, peak: DataFrame, quantity: str = "peak_power_kW") -> DataFrame:
    """display text of today's cards (:func:`kpi_today`) and of the month's peak (:func:`kpi_month_peak`)."""
    number = lambda c: F.format_number(F.bround(F.coalesce(c, F.lit(0.0)), 1), 1)
    left = today.select(
        F.lit(1).alias("_one"),
        F.concat(number("kwh_today"), F.lit(" kWh")).alias("kwh_today_text"),
        F.format_number(F.col("sessions_today"), 0).alias("users_today_text"),
        _change_text("kwh_change_pct", "%+.0f%%", 0, "yesterday").alias("kwh_change_text"),
        _change_text("users_change", "%+.0f users", 0, "yesterday").alias("users_change_text"))
    right = peak.select(
        F.lit(1).alias("_one"), F.concat(number(quantity), F.lit(" kW")).alias("peak_text"),
        _change_text("change_pct", "%+.1f%%", 1, "last month").alias("peak_change_text"))
    return left.join(right, "_one", "left").drop("_one")   # one row each


USER_SKETCH_BITS = 12   # relative standard error of a count: about 1.04 / sqrt(2 ** bits) = 1.6 %


def daily_user_sketches(sessions: DataFrame, by=(), bits: int = USER_SKETCH_BITS) -> DataFrame:
    """A12 over any range: (by..., day, users, user_sketch), exact users of each day and a mergeable sketch of them.

    Distinct counts of days do not add up; sketches do.  The table has one row
    a day (and key), is kept by day, and a new day touches no other.  Users are
    counted by the day they connected; rows without a user or a time do not count.
    """
    rows = sessions.filter("userId IS NOT NULL AND connectTime IS NOT NULL").select(
        *by, F.to_date("connectTime").alias("day"), "userId").distinct()
    return rows.groupBy(*by, "day").agg(F.count("*").alias("users"), F.hll_sketch_agg("userId", bits).alias("user_sketch"))


def users_between(sketches: DataFrame, start=None, end=None, by=()) -> DataFrame:
    """(by..., users): distinct users of the days from ``start`` to ``end``, both included, from stored sketches."""
    if start is not None:
        sketches = sketches.filter(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        sketches = sketches.filter(F.col("day") <= F.lit(end).cast("date"))
    return sketches.groupBy(*by).agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("user_sketch")), F.lit(0)).alias("users"))
