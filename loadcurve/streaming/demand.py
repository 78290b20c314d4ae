"""T1 + T4: 5-minute demand of a stream of sessions.

:func:`stream_demand` keeps the newest report of each session in state and is
exact over any number of batches (``load_changes``).

:func:`windowed_demand` is the plain windowed sum for a source that gives each
session once and in order; a session's slots reach back a day, so load further
back than the watermark is dropped when a source has many batches.  Stateless part (per micro-batch): session mapping, cleaning, slot expansion.
Stateful part: ``withWatermark`` on the slot time (cast to TIMESTAMP -- a
watermark cannot be on TIMESTAMP_NTZ) and ``groupBy(window(5 minutes))``.
Append mode emits a window once the watermark (max slot time seen - 16
minutes, the reference's freshness pad) passes its end; rows for windows
already closed are dropped as late (T4).  ``availableNow`` processes what is
there and stops, with exactly-once file output and a checkpoint for restarts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcurve.functions.timecols import as_ntz, slot_index
from loadcurve.operators.clean import clean_sessions
from loadcurve.operators.timegrid import expand_slots
from loadcurve.session import scratch_path
from loadcurve.streaming.load_changes import closed_demand, run_demand_changes
from loadcurve.streaming.sources import file_stream, start_with_state_partitions

WATERMARK = "16 minutes"


def slot_stream(sessions_raw_stream: DataFrame, as_of=None) -> DataFrame:
    """Cleaned sessions -> (ts TIMESTAMP, power_W) rows, one per slot."""
    s = clean_sessions(sessions_raw_stream)
    slots = expand_slots(s, "startChargeTime", "finishChargeTime",
                         [F.col("true_peakPower_W").alias("power_W")], time_col="time")
    if as_of is not None:
        slots = slots.filter(F.col("slot") <= slot_index(as_ntz(as_of), 300, "floor"))
    return slots.select(F.col("time").cast("timestamp").alias("ts"), "power_W")


def windowed_demand(slots: DataFrame, watermark: str = WATERMARK, size: str = "5 minutes") -> DataFrame:
    """Summed power per window; ``energy_kWh`` counts each 5-minute slot as 1/12 hour."""
    return (slots.withWatermark("ts", watermark)
                 .groupBy(F.window("ts", size))
                 .agg(F.sum("power_W").alias("power_W"))
                 .select(F.col("window.start").cast("timestamp_ntz").alias("time"), "power_W",
                         (F.col("power_W") / 12000.0).alias("energy_kWh")))


def run_demand_stream(spark: SparkSession, sessions_raw_stream: DataFrame, as_of=None,
                      out_path: str | None = None, checkpoint: str | None = None,
                      watermark: str = WATERMARK, size: str = "5 minutes",
                      state_partitions: int | None = None) -> str:
    """Run to the end of the available input (``availableNow``); returns the output folder."""
    out_path = out_path or scratch_path(spark, "stream-demand-out")
    checkpoint = checkpoint or scratch_path(spark, "stream-demand-ckpt")
    writer = (windowed_demand(slot_stream(sessions_raw_stream, as_of), watermark, size)
              .writeStream.outputMode("append").format("parquet")
              .option("path", out_path).option("checkpointLocation", checkpoint)
              .trigger(availableNow=True))
    q = start_with_state_partitions(spark, writer, state_partitions)
    q.awaitTermination()
    return out_path


def stream_demand(spark: SparkSession, events_path: str, as_of, schema, size: str = "5 minutes",
                  state_partitions: int | None = None) -> DataFrame:
    """Demand per window of ``size``, for windows that ended ``WATERMARK`` before the newest slot."""
    from loadcurve.sources.fixtures import sessions_from_events
    ev = file_stream(spark, events_path, schema)
    changes = run_demand_changes(spark, sessions_from_events(ev), state_partitions=state_partitions)
    seconds = {"5 minutes": 300, "1 hour": 3600}[size]
    return closed_demand(spark.read.parquet(changes), as_of, seconds, WATERMARK)
