"""Sources: declared-schema scans in several formats, flattening, tables."""

import datetime as dt
import json

from pyspark.sql import functions as F

from conftest import SF_SMALL
from loadcurve.plans.common import raw
from loadcurve.schemas import SESSIONS_RAW
from loadcurve.session import scratch_path
from loadcurve.sources import tables as TB


def _rows(df):
    return sorted(tuple(r) for r in df.select(*SESSIONS_RAW.fieldNames()).collect())


def test_scan_sessions_parquet_json_csv(spark):
    r = raw(spark, SF_SMALL)
    want = _rows(r)
    for fmt in ("parquet", "json", "csv"):
        path = scratch_path(spark, f"scan-{fmt}")
        w = r.write.mode("overwrite")
        if fmt == "csv":
            w = w.option("header", True)
        w.format(fmt).save(path)
        assert _rows(TB.scan_sessions(spark, path, fmt)) == want, fmt


def test_flatten_nested_json(spark):
    doc = json.dumps({"a": {"b": 1, "c": {"d": "x"}}, "e": 2.5})
    df = spark.createDataFrame([(1, doc)], "id long, j string")
    flat = TB.flatten(TB.parse_json(df, "j", "a struct<b int, c struct<d string>>, e double"))
    assert flat.columns == ["id", "j.a.b", "j.a.c.d", "j.e"]
    assert tuple(flat.first()) == (1, 1, "x", 2.5)


def test_tables_and_params(spark):
    root = scratch_path(spark, "tables-test")
    df = spark.range(10).withColumn("ym", F.lit("2024-01"))
    TB.write_table(df, "t", root, partition_by=["ym"])
    assert TB.table_exists(spark, "t", root) and not TB.table_exists(spark, "u", root)
    (t,) = TB.read_tables(spark, ["t"], root)
    assert t.count() == 10
    params = spark.createDataFrame([("knn", "hourly", "energy_demand_kWh", 3, 5)],
                                   "model string, series string, quantity string, best_depth int, best_n_neighbors int")
    TB.save_params(params, root)
    got = TB.load_params(spark, root, "knn", "hourly").collect()
    assert [(r.best_depth, r.best_n_neighbors) for r in got] == [(3, 5)]
    assert TB.load_params(spark, root, "other").count() == 0


def test_cluster_settings_fill_only_unset_keys(spark):
    from loadcurve.session import apply_cluster_settings
    before = spark.conf.get("spark.sql.shuffle.partitions")          # set by the test session
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        apply_cluster_settings(spark)
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "256m"
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.autoBroadcastJoinThreshold",
                  "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"):
            spark.conf.unset(k)


def test_text_dates_and_ids(spark):
    from loadcurve.sources import tables as TB
    rows = [("1", "01/31/2024 00:16:06"), ("2", "2024-01-31 00:16:06"), ("3", "2024-01-31T00:16:06.250000"),
            ("x", "31.01.2024"), (None, None)]
    got = TB.parse_texts(spark.createDataFrame(rows, "dcosId string, lastUpdate string")).collect()
    t = dt.datetime(2024, 1, 31, 0, 16, 6)
    assert [tuple(r) for r in got] == [(1, t), (2, t), (3, t.replace(microsecond=250000)), (None, None), (None, None)]
