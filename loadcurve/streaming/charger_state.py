"""Live charger state with ``applyInPandasWithState``.

State per station: its newest report (lastUpdate, dcosId, rate, choice).  A
newer report replaces it and emits ``IN USE``.  The watermark lags the newest
report by 16 minutes, so a station whose last report it passes is more than 16
minutes old: the event-time timeout at that report emits ``IDLE`` and drops the
state.  A late report that the watermark has already passed is ``IDLE`` at once.  Output rows are state changes (append), so the current
state of a station is its latest change.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from loadcurve.session import scratch_path
from loadcurve.sources.tables import remove_path, subfolders
from loadcurve.streaming.sources import start_with_state_partitions

FRESH = "16 minutes"

OUT = T.StructType([
    T.StructField("stationId", T.LongType()), T.StructField("dcosId", T.LongType()),
    T.StructField("lastUpdate", T.TimestampType()), T.StructField("currentChargingRate", T.DoubleType()),
    T.StructField("state", T.StringType())])
STATE = T.StructType([
    T.StructField("last_ms", T.LongType()), T.StructField("dcosId", T.LongType()),
    T.StructField("rate", T.DoubleType())])


def _step(key, pdfs, state):
    station = int(key[0])
    if state.hasTimedOut:
        last_ms, dcos, rate = state.get
        state.remove()
        yield pd.DataFrame([[station, dcos, pd.Timestamp(last_ms, unit="ms"), rate, "IDLE"]], columns=OUT.fieldNames())
        return
    best = state.get if state.exists else None
    for pdf in pdfs:
        if pdf.empty:
            continue
        ms = pdf["lastUpdate"].astype("int64") // 1_000_000 if str(pdf["lastUpdate"].dtype).startswith("datetime64[ns") \
            else pdf["lastUpdate"].map(lambda t: int(pd.Timestamp(t).value // 1_000_000))
        pdf = pdf.assign(_ms=ms.astype("int64")).sort_values(["_ms", "dcosId"], ascending=[False, True])
        top = pdf.iloc[0]
        cand = (int(top["_ms"]), int(top["dcosId"]), float(top["true_peakPower_W"]) if pd.notna(top["true_peakPower_W"]) else None)
        if best is None or (cand[0], -cand[1]) > (best[0], -best[1]):
            best = cand
    if best is None:
        return
    watermark = state.getCurrentWatermarkMs()
    stale = best[0] < watermark
    if not stale:
        state.update(best)
        state.setTimeoutTimestamp(max(best[0], watermark + 1))
    elif state.exists:
        state.remove()
    yield pd.DataFrame([[station, best[1], pd.Timestamp(best[0], unit="ms"), best[2], "IDLE" if stale else "IN USE"]],
                       columns=OUT.fieldNames())


def charger_state_stream(sessions_stream: DataFrame) -> DataFrame:
    s = (sessions_stream.select("stationId", "dcosId", F.col("lastUpdate").cast("timestamp").alias("lastUpdate"),
                                "true_peakPower_W")
         .withWatermark("lastUpdate", FRESH))
    return s.groupBy("stationId").applyInPandasWithState(
        _step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_charger_state(spark: SparkSession, sessions_stream: DataFrame, out_path: str | None = None,
                      checkpoint: str | None = None, state_partitions: int | None = None) -> str:
    out_path = out_path or scratch_path(spark, "charger-state-out")
    checkpoint = checkpoint or scratch_path(spark, "charger-state-ckpt")
    writer = (charger_state_stream(sessions_stream).writeStream.outputMode("append").format("parquet")
              .option("path", out_path).option("checkpointLocation", checkpoint)
              .trigger(availableNow=True))
    q = start_with_state_partitions(spark, writer, state_partitions)
    q.awaitTermination()
    return out_path


def current_state(changes: DataFrame) -> DataFrame:
    """Latest change per station (IDLE wins over IN USE at the same report)."""
    w = Window.partitionBy("stationId").orderBy(F.col("lastUpdate").desc(),
                                                (F.col("state") == "IDLE").cast("int").desc())
    return changes.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1).drop("_rk")


_REPORT = ("lastUpdate", "dcosId", "true_peakPower_W", "choice", "vehicle_model")
FOLDED = 20   # batches before the newest reports are written as one folder


def _newest(rows: DataFrame) -> DataFrame:
    """The newest report of each station (then the smaller id): a window group limit, so a task hands on one a station."""
    w = Window.partitionBy("stationId").orderBy(F.col("lastUpdate").desc(), F.col("dcosId"))
    return rows.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk")


def run_newest_reports(spark: SparkSession, sessions: DataFrame, path: str | None = None,
                       checkpoint: str | None = None) -> str:
    """T2 without state in Python: each batch leaves one row per station and batch, so any order of reports will do.

    A batch writes its stations' newest reports under its number (a replay
    overwrites them); every ``FOLDED`` batches all are folded into one folder, a
    row per station.  Gives the folder.
    """
    path = path or scratch_path(spark, "station-reports")
    checkpoint = checkpoint or scratch_path(spark, "station-reports-ckpt")

    def write(batch: DataFrame, epoch: int) -> None:
        rows = _newest(batch.filter("stationId IS NOT NULL").select("stationId", *_REPORT))
        rows.write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        older = [f for f in subfolders(spark, path) if int(f.split("=")[1]) < epoch]
        if len(older) >= FOLDED:   # the newest of newest ones: folding again says the same
            staged = f"{path}-staging"
            _newest(spark.read.parquet(path).drop("batch")).write.mode("overwrite").parquet(staged)
            spark.read.parquet(staged).write.mode("overwrite").parquet(f"{path}/batch={epoch}")
            for f in older:
                remove_path(spark, f"{path}/{f}")

    q = (sessions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return path


def newest_state(spark: SparkSession, path: str, fresh: str = FRESH) -> DataFrame:
    """Each station's newest report, in use unless it lies ``fresh`` behind the newest report of all."""
    rows = _newest(spark.read.parquet(path).drop("batch"))
    last = rows.agg(F.max("lastUpdate")).scalar()
    idle = F.col("lastUpdate") + F.expr(f"INTERVAL {fresh}") < last
    return rows.select("stationId", "dcosId", "lastUpdate", F.col("true_peakPower_W").alias("currentChargingRate"),
                       "choice", "vehicle_model", F.when(idle, "IDLE").otherwise("IN USE").alias("state"))
