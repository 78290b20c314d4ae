"""Grid semantics, empty inputs and streaming late data."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from loadcurve.operators import grid as G
from loadcurve.operators import kpi as K
from loadcurve.operators import status as ST
from loadcurve.plans.common import raw, sessions


@pytest.fixture(scope="module")
def table(spark):
    return G.grid_table(sessions(spark, SF_SMALL)).cache()


def test_or_has_no_duplicates(spark, table):
    req = {"filterModel": {"cumEnergy_Wh": {"operator": "OR",
                                            "condition1": {"filterType": "number", "type": "lessThan", "filter": 9000},
                                            "condition2": {"filterType": "number", "type": "lessThan", "filter": 20000}}}}
    got = G.grid_query(table, req).rows
    assert got.count() == got.select("dcosId").distinct().count() == table.filter("cumEnergy_Wh < 20000").count()


def test_unknown_column_or_type_raises(spark, table):
    with pytest.raises(ValueError):
        G.grid_query(table, {"filterModel": {"nope": {"type": "equals", "filter": 1}}})
    with pytest.raises(ValueError):
        G.grid_query(table, {"filterModel": {"stationId": {"type": "almost", "filter": 1}}})


def test_page_past_end_is_empty_and_count_is_total(spark, table):
    res = G.grid_query(table, {"startRow": 10 ** 6, "endRow": 10 ** 6 + 100})
    assert res.rows.count() == 0
    assert res.row_count.first().rowCount == table.count()


def test_default_order_is_newest_first(spark, table):
    first = G.grid_query(table, {"startRow": 0, "endRow": 1}).rows.first()
    assert first.connectTime == table.agg(F.max("connectTime")).first()[0]


def test_empty_day_gives_zero_cards(spark):
    r = raw(spark, SF_SMALL)
    s = sessions(spark, SF_SMALL)
    later = dt.datetime(2030, 1, 1, 12)
    k = K.kpi_today(r, later).first()
    assert (k.kwh_today, k.sessions_today, k.kwh_change_pct, k.users_change) == (0.0, 0, 0.0, 0)
    ch = ST.charger_status(s, later).collect()
    assert ch and all(c.inUse == 0 and c.todayEnergy_Wh == 0.0 for c in ch)


def test_stream_drops_late_windows(spark):
    from loadcurve.streaming.demand import windowed_demand
    from loadcurve.session import scratch_path
    src = tempfile.mkdtemp(prefix="lc-stream-src-")
    out, ck = scratch_path(spark, "late-out"), scratch_path(spark, "late-ck")
    t0 = dt.datetime(2024, 1, 1, 12, 0)
    schema = "ts timestamp, power_W double"
    # one file, so one micro-batch: in two files of one row the later hour could be read first
    spark.createDataFrame([(t0, 1.0), (t0 + dt.timedelta(hours=1), 2.0)], schema).coalesce(1).write.parquet(
        os.path.join(src, "a"))
    stream =spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    q = (windowed_demand(stream).writeStream.outputMode("append").format("parquet")
         .option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    # second file: one row far behind the watermark (late -> dropped), one new
    spark.createDataFrame([(t0 + dt.timedelta(minutes=5), 5.0), (t0 + dt.timedelta(hours=2), 3.0)], schema) \
         .write.parquet(os.path.join(src, "b"))
    q = (windowed_demand(spark.readStream.schema(schema).parquet(os.path.join(src, "*")))
         .writeStream.outputMode("append").format("parquet")
         .option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.time: r.power_W for r in spark.read.parquet(out).collect()}
    assert got[t0] == 1.0 and got[t0 + dt.timedelta(hours=1)] == 2.0
    assert t0 + dt.timedelta(minutes=5) not in got


def test_charger_state_stream_newest_report_and_idle_timeout(spark):
    from loadcurve.session import scratch_path
    from loadcurve.streaming import charger_state as SCS
    src = tempfile.mkdtemp(prefix="lc-state-src-")
    t0 = dt.datetime(2024, 1, 1, 12, 0)
    schema = "stationId long, dcosId long, lastUpdate timestamp_ntz, true_peakPower_W double"
    spark.createDataFrame([(1, 10, t0, 1000.0), (1, 11, t0 + dt.timedelta(minutes=5), 2000.0),
                           (2, 20, t0, 3000.0)], schema).write.parquet(os.path.join(src, "a"))
    spark.createDataFrame([(2, 21, t0 + dt.timedelta(hours=2), 4000.0)], schema).write.parquet(os.path.join(src, "b"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    out = SCS.run_charger_state(spark, stream, scratch_path(spark, "state-out"), scratch_path(spark, "state-ck"))
    changes = spark.read.parquet(out)
    cur = {r.stationId: (r.dcosId, r.state) for r in SCS.current_state(changes).collect()}
    # station 1: newest report (11) went idle once the watermark passed its time + 16 minutes
    assert cur[1] == (11, "IDLE")
    # station 2: the newest report (21) is still in use at the end of the input
    assert cur[2] == (21, "IN USE")
    assert changes.filter((F.col("stationId") == 1) & (F.col("state") == "IN USE")).count() >= 1
