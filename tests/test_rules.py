"""Hand cases for the pandas rules the engine reproduces on purpose."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loadcurve.operators import clean as C
from loadcurve.operators import rollup as R
from loadcurve.operators.timegrid import expand_slots
from loadcurve.schemas import SESSIONS_RAW

T0 = dt.datetime(2024, 3, 10, 0, 0, 0)


def session(i, start, finish, energy=6600.0, hours=1.0, deadline=None, duration="0 days 01:00:00",
            peak=6600.0, station=1, site=25, user="1", model="m", choice="REGULAR"):
    return (i, user, site, station, start - dt.timedelta(minutes=2), start, deadline, finish, duration, hours,
            energy, peak, choice, model, 100, 150, "x@example.org", i)


def frame(spark, rows):
    return spark.createDataFrame(rows, SESSIONS_RAW)


def test_null_energy_survives_zero_filter_and_zeros_drop(spark):
    rows = [session(1, T0, T0 + dt.timedelta(hours=1), energy=None),
            session(2, T0, T0 + dt.timedelta(hours=1), energy=0.0),
            session(3, T0, T0 + dt.timedelta(hours=1), peak=0.0),
            session(4, T0, T0 + dt.timedelta(hours=1))]
    out = C.clean_sessions(frame(spark, rows))
    assert sorted(r.dcosId for r in out.collect()) == [1, 4]
    assert "user_email" not in out.columns and "paymentId" not in out.columns


def test_zero_hours_gives_null_power_and_adds_nothing(spark):
    rows = [session(1, T0, T0 + dt.timedelta(minutes=10), hours=0.0),
            session(2, T0, T0 + dt.timedelta(minutes=10), energy=1200.0, hours=1.0)]
    s = C.clean_sessions(frame(spark, rows))
    assert {r.dcosId: r.true_peakPower_W for r in s.collect()} == {1: None, 2: 1200.0}
    d = R.demand_watts(s, T0 + dt.timedelta(minutes=10)).orderBy("time").collect()
    assert [r.w for r in d] == [1200.0, 1200.0, 1200.0]


def test_half_even_rounding_of_slots(spark):
    # 00:02:30 -> 00:00 (even), 00:07:30 -> 00:10 (even multiple of 5 min is 00:10)
    df = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=2, seconds=30), T0 + dt.timedelta(minutes=7, seconds=30))],
                               "id long, s timestamp_ntz, e timestamp_ntz")
    got = [r.time for r in expand_slots(df, "s", "e", ["id"]).orderBy("time").collect()]
    assert got == [T0, T0 + dt.timedelta(minutes=5), T0 + dt.timedelta(minutes=10)]


def test_finish_before_start_gives_no_slot(spark):
    df = spark.createDataFrame([(1, T0 + dt.timedelta(hours=1), T0)], "id long, s timestamp_ntz, e timestamp_ntz")
    assert expand_slots(df, "s", "e", ["id"]).count() == 0


def test_overstay_rules(spark):
    rows = [session(1, T0, T0 + dt.timedelta(hours=26), deadline=T0 + dt.timedelta(hours=1), hours=20.0,
                    duration="1 days 02:00:00"),
            session(2, T0, T0 + dt.timedelta(hours=1), deadline=None),
            session(3, T0, T0 + dt.timedelta(hours=1), deadline=T0 + dt.timedelta(hours=3))]
    got = {r.dcosId: (r.Overstay_s, r.Overstay_h, r.Overstay_total_h)
           for r in C.clean_sessions(frame(spark, rows)).collect()}
    assert got[1] == (25 * 3600, 1.0, 25.0)      # whole days dropped in Overstay_h (Timedelta.seconds)
    assert got[2] == (0, 0.0, 0.0)               # no deadline -> 0
    assert got[3] == (0, 0.0, 0.0)               # left before the deadline -> 0


def test_day_count_rules(spark):
    rows = [session(1, T0, T0 + dt.timedelta(hours=1), duration="3 days 00:00:00"),
            session(2, T0, T0 + dt.timedelta(hours=1), duration="10 days 00:00:00"),
            session(3, T0, T0 + dt.timedelta(hours=1), duration="no day count"),
            session(4, T0, T0 + dt.timedelta(hours=1), duration="2 days 00:00:00")]
    full = sorted(r.dcosId for r in C.clean_sessions(frame(spark, rows)).collect())
    today = sorted(r.dcosId for r in C.clean_sessions(frame(spark, rows), max_days=1, day_rule="first_char").collect())
    assert full == [4]            # regex day count <= 2; unmatched text dropped
    assert today == [2]           # first character only: "10 days" passes (reference quirk)


def test_dst_day_wall_clock_does_not_move(spark):
    # 2024-03-10 02:30 does not exist in US/Pacific; NTZ keeps it as written
    start = dt.datetime(2024, 3, 10, 2, 30)
    df = spark.createDataFrame([(1, start, start + dt.timedelta(minutes=5))], "id long, s timestamp_ntz, e timestamp_ntz")
    got = [r.time for r in expand_slots(df, "s", "e", ["id"]).orderBy("time").collect()]
    assert got == [start, start + dt.timedelta(minutes=5)]


def test_closed_left_drops_last_slot(spark):
    df = spark.createDataFrame([(1, T0, T0 + dt.timedelta(hours=1))], "id long, s timestamp_ntz, e timestamp_ntz")
    assert expand_slots(df, "s", "e", ["id"]).count() == 13
    assert expand_slots(df, "s", "e", ["id"], closed="left").count() == 12


def test_spine_extends_to_as_of_and_cuts_future(spark):
    rows = [session(1, T0, T0 + dt.timedelta(minutes=10), energy=600.0, hours=1.0),
            session(2, T0 + dt.timedelta(hours=5), T0 + dt.timedelta(hours=6), energy=600.0, hours=1.0)]
    s = C.clean_sessions(frame(spark, rows))
    d = R.demand_watts(s, T0 + dt.timedelta(minutes=30)).orderBy("time").collect()
    assert [r.time for r in d] == [T0 + dt.timedelta(minutes=5 * i) for i in range(7)]
    assert [r.w for r in d] == [600.0] * 3 + [0.0] * 4


@pytest.mark.parametrize("after,before,want", [(0.0, 0.0, 0.0), (5.0, 0.0, 100.0), (5.0, 10.0, -50.0), (None, 4.0, -100.0)])
def test_pct_change(spark, after, before, want):
    from loadcurve.functions.scalars import pct_change
    df = spark.createDataFrame([(after, before)], "a double, b double")
    assert df.select(pct_change("a", "b").alias("c")).first().c == want


def test_month_end_labels_and_leap_day(spark):
    feb28 = dt.datetime(2024, 2, 28, 23, 0)
    rows = [session(1, feb28, feb28 + dt.timedelta(hours=2), energy=6600.0, hours=2.0)]
    s = C.clean_sessions(frame(spark, rows))
    as_of = dt.datetime(2024, 3, 1, 0, 30)
    monthly = {r.time: r for r in R.rollup(R.demand_5min(s, as_of), "month").collect()}
    assert set(monthly) == {dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 31)}
    assert monthly[dt.datetime(2024, 2, 29)].day == "Wednesday"     # first row: Feb 28 23:00
    assert monthly[dt.datetime(2024, 3, 31)].month == "March"
    daily = {r.time for r in R.rollup(R.demand_5min(s, as_of), "day").collect()}
    assert daily == {dt.datetime(2024, 2, 28), dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 1)}


def test_empty_inputs(spark):
    from loadcurve.operators import analytics as A
    from loadcurve.operators import forecasts as FC
    from loadcurve.operators import kpi as K
    from loadcurve.operators import status as ST
    from loadcurve.operators import today as TD
    empty = frame(spark, [])
    s = C.clean_sessions(empty)
    as_of = T0 + dt.timedelta(hours=1)
    assert R.demand_5min(s, as_of).count() == 0
    assert ST.charger_status(s, as_of).count() == 0
    assert TD.todays_sessions(empty, as_of).count() == 0
    assert A.cumulative_energy(s).count() == 0
    k = K.kpi_today(empty, as_of).first()
    assert (k.kwh_today, k.sessions_today, k.kwh_yesterday, k.users_yesterday) == (0.0, 0, 0.0, 0)
    none = FC.empty_forecasts(spark)
    assert FC.upsert_forecasts(none, none).count() == 0


@pytest.mark.parametrize("kind,want", [
    ("last_days", (dt.datetime(2024, 1, 23), dt.datetime(2024, 1, 31))),
    ("month", (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31))),
    ("year", (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31))),
    ("all", (None, None)),
])
def test_relative_ranges(kind, want):
    from loadcurve.operators.explore import relative_range
    assert relative_range(kind, dt.datetime(2024, 1, 30, 12), 7) == want


def test_end_bound_is_midnight_unless_inclusive(spark):
    from loadcurve.operators.explore import between_dates
    df = spark.createDataFrame([(dt.datetime(2024, 1, 10, 0, 0),), (dt.datetime(2024, 1, 10, 13, 0),),
                                (dt.datetime(2024, 1, 11, 0, 0),)], "time timestamp_ntz")
    assert between_dates(df, "time", "2024-01-10", "2024-01-10").count() == 1
    assert between_dates(df, "time", "2024-01-10", "2024-01-10", end_inclusive_day=True).count() == 2
    assert between_dates(df, "time", None, None).count() == 3
    assert between_dates(df, "time", "01/11/2024", None).count() == 1
