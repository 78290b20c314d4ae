"""Invariants on sf0.001: sums across granularities, gap-free spine, running totals, keys."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from loadcurve.operators import analytics as A
from loadcurve.operators import rollup as R
from loadcurve.operators import status as ST
from loadcurve.operators.ordered import global_running_sum
from loadcurve.plans.common import sessions
from loadcurve.sources.fixtures import AS_OF


@pytest.fixture(scope="module")
def sess(spark):
    return sessions(spark, SF_SMALL).cache()


def test_energy_equal_across_granularities(spark, sess):
    t = R.demand_tables(sess, AS_OF)
    totals = [t[n].agg(F.sum("energy_demand_kWh")).first()[0] for n in
              ("demand_5min", "demand_hourly", "demand_daily", "demand_monthly")]
    assert max(totals) - min(totals) < 1e-6 * max(totals)


def test_spine_has_no_gap_and_no_duplicate(spark, sess):
    d5 = R.demand_5min(sess, AS_OF)
    n, lo, hi, distinct = d5.agg(F.count("*"), F.min("time"), F.max("time"), F.countDistinct("time")).first()
    assert n == distinct == int((hi - lo).total_seconds() // 300) + 1
    assert hi == dt.datetime(2024, 1, 30, 12, 0)


def test_running_total_is_monotone_and_ends_at_total(spark, sess):
    ce = A.cumulative_energy(sess).filter(F.col("cum_energy_kWh").isNotNull())
    w = Window.orderBy("finishChargeTime", "dcosId")
    bad = ce.withColumn("prev", F.lag("cum_energy_kWh").over(w)).filter(F.col("cum_energy_kWh") < F.col("prev"))
    assert bad.count() == 0
    total = sess.agg(F.sum("cumEnergy_Wh")).first()[0] / 1000
    assert abs(ce.agg(F.max("cum_energy_kWh")).first()[0] - total) < 1e-6


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_global_running_sum_equals_window(spark, ranges):
    df = spark.range(0, 2000).select(F.col("id"), ((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 13).alias("v"))
    got = global_running_sum(df, [F.col("k"), F.col("id")], F.col("v"), "run", num_ranges=ranges)
    ref = df.withColumn("ref", F.sum("v").over(Window.orderBy("k", "id").rowsBetween(Window.unboundedPreceding, 0)))
    assert got.join(ref, "id").filter(F.col("run") != F.col("ref")).count() == 0


def test_histogram_percent_sums_to_100(spark, sess):
    h = A.histogram_by_hour(R.rollup(R.demand_5min(sess, AS_OF), "hour"), "avg_power_demand_kW")
    for r in h.groupBy("hour").agg(F.sum("percent").alias("p")).collect():
        assert abs(r.p - 100.0) < 1e-9


def test_keyed_demand_equals_single_series_per_station(spark, sess):
    keyed = R.demand_watts(sess, AS_OF, by=["stationId"])
    for station in (1, 5):
        one = R.demand_watts(sess.filter(F.col("stationId") == station), AS_OF)
        a = {r.time: r.w for r in keyed.filter(F.col("stationId") == station).collect()}
        b = {r.time: r.w for r in one.collect()}
        assert a == b


def test_charger_flags_and_shares(spark, sess):
    ch = ST.charger_status(sess, AS_OF).collect()
    assert all(r.inUse in (0, 1) for r in ch)
    assert all((r.inUse == 1) == (r.state == "IN USE") for r in ch)
    assert all((r.currentChargingRate is None) or r.inUse == 1 for r in ch)


def test_user_profile_shares(spark, sess):
    from loadcurve.operators.clean import session_subset
    up = A.user_profile(session_subset(sess)).collect()
    assert sum(r.num_sessions for r in up) == sess.filter(F.col("userId").isNotNull()).count()
    assert all(0 < r.pref_charging_choice_percent <= 1 for r in up)


@pytest.mark.parametrize("by", [[], ["stationId"]])
@pytest.mark.parametrize("closed", ["both", "left"])
def test_delta_load_curve_equals_exploded(spark, sess, by, closed):
    a = {tuple(r): None for r in R.demand_watts(sess, AS_OF, by, closed, method="delta").collect()}
    b = {tuple(r): None for r in R.demand_watts(sess, AS_OF, by, closed, method="explode").collect()}
    assert a.keys() == b.keys()


def test_cumulative_energy_by_day_ends_where_rows_end(spark, sess):
    rows = A.cumulative_energy(sess).agg(F.max("cum_energy_kWh")).first()[0]
    days = A.cumulative_energy(sess, grain="day").orderBy("day").collect()
    assert abs(days[-1].cum_energy_kWh - rows) < 1e-6
    assert all(a.cum_energy_kWh <= b.cum_energy_kWh for a, b in zip(days, days[1:]))
