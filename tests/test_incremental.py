"""State and change sets over many batches: incremental demand, upserts, refresh by change, rebuilt tables."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from loadcurve.operators import clean as C
from loadcurve.operators import rollup as R
from loadcurve.plans import incremental as INC
from loadcurve.plans import jobs
from loadcurve.plans import registry as REG
from loadcurve.schemas import SESSIONS_RAW
from loadcurve.session import scratch_path
from loadcurve.sources import fixtures as FX
from loadcurve.sources import tables as TB
from loadcurve.streaming import load_changes as LC
from loadcurve.streaming import upsert as SU
from loadcurve.streaming.sources import file_stream

T0 = dt.datetime(2024, 1, 10, 8, 0)
AS_OF = dt.datetime(2024, 1, 14, 12, 0)


def report(sid, start, hours, at=None, energy=6000.0, connect=None, site=25):
    """A raw report of a session that began ``start`` hours after T0 and has run for ``hours``."""
    begin = T0 + dt.timedelta(hours=start)
    end = begin + dt.timedelta(hours=hours)
    at = at or end
    return {"dcosId": sid, "userId": "u", "siteId": site, "stationId": 1, "connectTime": connect or begin,
            "startChargeTime": begin, "lastUpdate": at, "Duration": "0 days 01:00:00", "DurationHrs": float(hours),
            "cumEnergy_Wh": energy, "peakPower_W": 6600.0, "choice": "REGULAR"}


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in SESSIONS_RAW.fieldNames()) for r in rows], SESSIONS_RAW)


def stage(spark, batches):
    path = scratch_path(spark, "test-reports")
    for rows in batches:
        frame(spark, rows).repartition(1).write.mode("append").parquet(path)
    return file_stream(spark, path, SESSIONS_RAW, max_files_per_trigger=1)


BATCHES = [
    [report(1, 0, 1), report(2, 1, 2), report(None, 0, 1), report(None, 0, 1), report(3, 0, 3)],
    [report(1, 0, 2, energy=14000.0), report(4, -20, 4)],                       # longer, and load far back
    [report(1, 0, 1, at=T0 + dt.timedelta(minutes=30)), report(3, 0, 3.5, energy=0.0)],   # late; cleaned away
    [report(2, 1, 2.5, connect=T0 - dt.timedelta(hours=30)), report(None, 5, 1), report(4, -20, 4)],   # other day; repeated
    [report(5, 70, 3, site=99)],
]
#: What the batches leave: the newest report of each session, rows without an id one by one.
FINAL = [report(1, 0, 2, energy=14000.0), report(None, 0, 1), report(None, 0, 1), report(3, 0, 3.5, energy=0.0),
         report(4, -20, 4), report(2, 1, 2.5, connect=T0 - dt.timedelta(hours=30)), report(None, 5, 1), report(5, 70, 3, site=99)]


def curve(df, by=()):
    return {tuple(r[c] for c in [*by, "time"]): r.avg_power_demand_kW for r in df.collect()}


@pytest.mark.parametrize("by", [[], ["siteId"]])
def test_incremental_demand_equals_the_batch_curve(spark, by):
    path = LC.run_demand_changes(spark, stage(spark, BATCHES), by=by, state_partitions=2)
    got = R.demand_features(LC.demand_curve(spark.read.parquet(path), AS_OF, by), by)
    assert len(glob.glob(os.path.join(path, "batch=*"))) >= len(BATCHES)
    assert curve(got, by) == curve(R.demand_5min(C.clean_sessions(frame(spark, FINAL)), AS_OF, by), by)


def test_session_state_is_merged_in_one_shuffle_without_python(spark):
    """Epoch by epoch, with a replay and a report without a time: what is held and what goes out."""
    state = scratch_path(spark, "test-session-state")
    no_time = report(8, 0, 1) | {"lastUpdate": None}
    held = []
    for epoch, rows in ((0, [*BATCHES[0], no_time]), (1, BATCHES[1]), (1, BATCHES[1]), (2, BATCHES[2])):
        ranges = LC.report_ranges(frame(spark, rows))
        merged = LC.merge_batch(spark, ranges, state, epoch)
        points = LC.change_points(merged).agg(F.sum("sessions"), F.sum(F.abs("sessions"))).first()
        held.append((merged.filter("held_on").count(), *points))
    # two points a range that goes on, two a range taken back
    assert held == [(3, 0, 10), (4, 0, 6), (4, 0, 6), (4, 0, 2)]
    plan = LC.merge_reports(ranges, spark.read.parquet(f"{state}/sessions/batch=1").filter("sid IS NOT NULL")
                            )._jdf.queryExecution().sparkPlan().toString()
    assert "Python" not in plan and "Join" not in plan


def test_a_report_without_a_time_does_not_end_the_stream(spark):
    path = LC.run_demand_changes(spark, stage(spark, [[report(1, 0, 1), report(8, 0, 1) | {"lastUpdate": None}]]))
    got = R.demand_features(LC.demand_curve(spark.read.parquet(path), AS_OF))
    assert curve(got) == curve(R.demand_5min(C.clean_sessions(frame(spark, [report(1, 0, 1)])), AS_OF))


def test_staged_rounds_and_slices_do_not_follow_the_input_splits(spark):
    """A round or a slice is one batch; before, each file was, and a batch rewrites what it touches."""
    sf = scratch_path(spark, "test-events")
    rows = [(i, T0 + dt.timedelta(minutes=7 * i), i % 9, "click", float(i % 50 + 1), None) for i in range(400)]
    spark.createDataFrame(rows, REG._EVENTS_SCHEMA).repartition(6).write.parquet(f"{sf}/events.parquet")
    path, files = REG._stage_ordered_reports(spark, sf)
    assert files == 1 and TB.data_files(spark, path) <= REG.REPORT_SLICES + 1
    assert spark.read.parquet(path).count() == 2 * len(rows)
    for staged, first in ((REG._stage_reports, 400), (REG._stage_moving_reports, 266)):
        path, files = staged(spark, sf)
        assert TB.data_files(spark, path) <= 2 * files and spark.read.parquet(path).count() == 400 + first


def test_state_goes_after_its_time_and_later_reports_are_late(spark):
    days = [[report(9, 0, 1)], [report(10, 24 * 6, 1)], [report(11, 24 * 7, 1)], [report(12, 1, 1)], [report(13, 24 * 8, 1)]]
    path = LC.run_demand_changes(spark, stage(spark, days), keep="4 days", state_partitions=1)
    changes = spark.read.parquet(path)
    assert changes.agg(F.sum("sessions")).first()[0] == 0     # what starts also ends
    starts = changes.filter("sessions > 0").agg(F.sum("sessions")).first()[0]
    assert starts == 4                                        # session 12 came 7 days behind the newest report


def test_upsert_moves_days_and_keeps_rows_without_an_id(spark):
    target = scratch_path(spark, "test-upsert")
    SU.run_upsert_stream(spark, stage(spark, BATCHES), target)
    stored = spark.read.parquet(target)
    rows = lambda df: sorted(map(str, df.select(*SESSIONS_RAW.fieldNames()).collect()))
    assert rows(stored) == rows(frame(spark, FINAL))
    # a replay of any batch changes nothing
    for epoch in range(len(BATCHES)):
        SU.merge_batch(spark, frame(spark, BATCHES[epoch]), target, epoch)
    # an old day that loses its last session goes
    alone = [report(77, 24 * 30, 1)]
    SU.merge_batch(spark, frame(spark, alone), target, 50)
    assert os.path.exists(f"{target}/day=2024-02-09")
    moved = report(77, 24 * 30, 2, connect=T0 + dt.timedelta(days=40))
    SU.merge_batch(spark, frame(spark, [moved]), target, 51)
    assert not os.path.exists(f"{target}/day=2024-02-09") and os.path.exists(f"{target}/day=2024-02-19")
    assert rows(spark.read.parquet(target).filter("day < '2024-02-01'")) == rows(frame(spark, FINAL))


def test_index_is_written_as_one_after_many_batches(spark, monkeypatch):
    monkeypatch.setattr(SU, "INDEX_BATCHES", 2)
    target = scratch_path(spark, "test-index")
    for epoch in range(5):
        SU.merge_batch(spark, frame(spark, [report(1, 24 * epoch, 1), report(100 + epoch, 0, 1)]), target, epoch)
    assert len(TB.subfolders(spark, f"{target}-index")) <= 3
    stored = spark.read.parquet(target)
    assert stored.count() == 6 and stored.filter("dcosId = 1").first().connectTime == T0 + dt.timedelta(days=4)


def test_upsert_and_refresh_begin_with_a_batch_without_rows(spark):
    root, target = scratch_path(spark, "test-empty-kept"), scratch_path(spark, "test-empty")

    def after(epoch):
        INC.refresh_changed(spark, root, SU.change_set(spark, target, epoch), epoch, AS_OF)

    SU.run_upsert_stream(spark, stage(spark, [[], BATCHES[0], BATCHES[1]]), target, after=after)
    final = [report(1, 0, 2, energy=14000.0), report(2, 1, 2), report(None, 0, 1), report(None, 0, 1), report(3, 0, 3),
             report(4, -20, 4)]
    stored = spark.read.parquet(target).select(*SESSIONS_RAW.fieldNames())
    assert sorted(map(str, stored.collect())) == sorted(map(str, frame(spark, final).collect()))
    assert kept(spark, root) == full(spark, final, AS_OF)


def test_refresh_before_the_first_session_has_no_row_yet(spark):
    root, target = scratch_path(spark, "test-early-kept"), scratch_path(spark, "test-early")
    SU.merge_batch(spark, frame(spark, BATCHES[0]), target, 0)
    changes = SU.change_set(spark, target, 0)
    INC.refresh_changed(spark, root, changes, 0, T0 - dt.timedelta(days=2))
    INC.refresh_changed(spark, root, changes.limit(0), 1, AS_OF)
    assert kept(spark, root) == full(spark, BATCHES[0], AS_OF)


def listed(df):
    """Rows as text, sums rounded: engines add in different orders."""
    return sorted(str((r.time, round(r.avg_power_demand_kW, 9), round(r.energy_demand_kWh, 9), r.peak_power_kW, r.day, r.month))
                  for r in df.collect())


def kept(spark, root):
    return {n: listed(INC.read_demand(spark, root, n)) for n in INC.GRAINS}


def full(spark, rows, as_of):
    d5 = R.demand_5min(C.clean_sessions(frame(spark, rows)), as_of)
    return {n: listed(d5 if g is None else R.rollup(d5, g)) for n, g in INC.GRAINS.items()}


def test_refresh_by_change_rewrites_only_touched_days(spark):
    root, target = scratch_path(spark, "test-kept"), scratch_path(spark, "test-kept-sessions")
    files = lambda name: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/{name}/**/part-*", recursive=True)}
    for epoch, rows in enumerate(BATCHES):
        SU.merge_batch(spark, frame(spark, rows), target, epoch)
        INC.refresh_changed(spark, root, SU.change_set(spark, target, epoch), epoch, AS_OF)
    assert kept(spark, root) == full(spark, FINAL, AS_OF)
    before = {n: files(n) for n in INC.GRAINS}
    late = [report(6, 30, 1)]          # one session on one day
    SU.merge_batch(spark, frame(spark, late), target, 5)
    days = INC.refresh_changed(spark, root, SU.change_set(spark, target, 5), 5, AS_OF)
    assert days == [dt.date(2024, 1, 11)]
    for name in ("demand_5min", "demand_hourly"):
        changed = {f for f, t in files(name).items() if before[name].get(f) != t}
        assert changed and all("on_day=2024-01-11" in f for f in changed)
    assert kept(spark, root) == full(spark, FINAL + late, AS_OF)
    # a replay changes no numbers; later and earlier times of the view follow
    INC.refresh_changed(spark, root, SU.change_set(spark, target, 5), 5, AS_OF)
    assert kept(spark, root) == full(spark, FINAL + late, AS_OF)
    none = SU.change_set(spark, target, 5).limit(0)
    for epoch, hours in ((6, 30), (7, -60)):
        as_of = AS_OF + dt.timedelta(hours=hours)
        INC.refresh_changed(spark, root, none, epoch, as_of)
        assert kept(spark, root) == full(spark, FINAL + late, as_of)


def test_refresh_by_change_of_keyed_series(spark):
    root, target, by = scratch_path(spark, "test-keyed"), scratch_path(spark, "test-keyed-sessions"), ["siteId"]
    for epoch, rows in enumerate(BATCHES):
        SU.merge_batch(spark, frame(spark, rows), target, epoch)
        INC.refresh_changed(spark, root, SU.change_set(spark, target, epoch), epoch, AS_OF, by)
    want = R.demand_5min(C.clean_sessions(frame(spark, FINAL)), AS_OF, by)
    assert curve(INC.read_demand(spark, root, "demand_5min"), by) == curve(want, by)


def test_missing_tables_are_rebuilt_and_only_they(spark):
    root, raw = scratch_path(spark, "test-rebuild"), FX.sessions_raw(spark, SF_SMALL)
    jobs.refresh(spark, raw, root, FX.AS_OF, source_version="1")
    site = jobs.open_site(spark, root, raw=raw)
    site.ensure("demand_hourly")
    assert site.built == []                                   # all there
    jobs.update_params(spark, root, depths=[2, 3], ks=[3, 4], orders=(1, 1))
    first = sorted(map(str, jobs.forecast_hourly(spark, root).collect()))
    times = {n: max(os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/{n}/**/part-*", recursive=True))
             for n in (*jobs.PRODUCTS, "knn_params", "seasonal_params")}
    TB.remove_path(spark, f"{root}/demand_hourly")
    assert sorted(map(str, jobs.forecast_hourly(spark, root).collect())) == first   # no source is needed
    after = {n: max(os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/{n}/**/part-*", recursive=True)) for n in times}
    assert {n for n in times if after[n] != times[n]} == {"demand_hourly"}
    # a lost table and what it comes from: both, in order
    for name in ("demand_5min", "demand_daily", "sessions"):
        TB.remove_path(spark, f"{root}/{name}")
    site = jobs.open_site(spark, root)
    site.ensure("demand_daily")
    assert site.built == ["sessions", "demand_5min", "demand_daily"]
    TB.remove_path(spark, f"{root}/reports")
    TB.remove_path(spark, f"{root}/sessions")
    with pytest.raises(RuntimeError):
        jobs.open_site(spark, root).ensure("sessions")
    # new settings or a new source: what hangs on them follows
    site = jobs.open_site(spark, root, raw=raw, as_of=str(FX.AS_OF - dt.timedelta(days=1)))
    site.ensure("demand_monthly")
    assert "demand_5min" in site.built and "sessions" in site.built and "chargers" not in site.built
    # parameters that are missing are searched by the job
    TB.remove_path(spark, f"{root}/knn_params")
    assert jobs.forecast_hourly(spark, root, raw=raw, depths=[2], ks=[3]).count() >= 24
    assert {r.best_depth for r in TB.load_params(spark, root, "knn", "hourly").collect()} == {2}


def test_update_params_resets_and_refits_both_tables(spark):
    root, by = scratch_path(spark, "test-params"), ["siteId"]
    jobs.refresh(spark, FX.sessions_raw(spark, SF_SMALL), root, FX.AS_OF, by)
    old = FX.hourly_series(spark, SF_SMALL).select(F.lit(25).alias("siteId"), F.timestamp_add("DAY", F.lit(-900), "time").alias("time"),
                                                   *[F.col("v").alias(f"{q}_predictions") for q in jobs.QUANTITIES])
    TB.write_table(old, "hourly_forecasts", root)
    params = jobs.update_params(spark, root, depths=[2, 4], ks=[3, 5], by=by, orders=(1, 1))
    assert {(r.siteId, r.quantity) for r in params.collect()} == {(s, q) for s in (25, 99) for q in jobs.QUANTITIES}
    hourly, daily = (TB.read_table(spark, n, root) for n in ("hourly_forecasts", "daily_forecasts"))
    assert hourly.groupBy("siteId").count().collect()[0]["count"] == 24        # the stored ones are gone
    assert {r["count"] for r in daily.groupBy("siteId").count().collect()} == {7}
    assert TB.read_table(spark, "seasonal_params", root).count() == 6
