"""T1 + T4: demand kept up to date from session reports, exact over any number of batches.

A session is reported again and again until it ends, and a new report changes
its slots and its power.  State per session holds the range and power that its
newest report has put on the curve: one row a session, joined with each
micro-batch by session in one shuffle (:func:`merge_batch`), no row of Python.
A newer report takes that back and puts its own on; an older one that comes
late changes nothing.  What goes out are signed change points (by..., slot, watts, sessions,
powered): +w where a range starts, -w after its end, and the same with the signs
turned for the range taken back.

Each micro-batch's change points are summed per slot and written under the
batch's number, so a replayed batch overwrites its own folder and the table
stays exact.  The curve at any time is the running sum of all change points
(:func:`demand_curve`): aggregated points of a bounded span, never sessions.

Reports that lie ``keep`` behind the newest one seen are dropped (T4), and the
state of a session goes once its last report lies ``keep`` behind that bound,
as a watermark of ``keep`` and a timer of ``keep`` would have it.  A session
lasts a day at most, so ``keep`` only has to cover its reports' lateness.
Reports without an id are sessions of their own and hold no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.functions.timecols import as_ntz, epoch_micros, floor_time, slot_index, slot_time
from loadcurve.operators.clean import keep_condition, with_helpers
from loadcurve.operators.rollup import STEP, fill_forward
from loadcurve.operators.timegrid import slot_bounds
from loadcurve.session import scratch_path
from loadcurve.sources.tables import path_exists, remove_path
from loadcurve.streaming.sources import start_with_state_partitions

KEEP = "4 days"
_MEASURES = [T.StructField("watts", T.DoubleType()), T.StructField("sessions", T.LongType()),
             T.StructField("powered", T.LongType())]


def report_ranges(raw: DataFrame, by=()) -> DataFrame:
    """A raw report as (sid, by..., at, tie, lo, hi, w): what it puts on the curve; ``at`` in microseconds.

    A report that cleaning drops puts nothing on (``lo > hi``), but still takes
    back what its session had.
    """
    tie = F.xxhash64(*raw.columns)
    lo, hi = slot_bounds("startChargeTime", "finishChargeTime", STEP)
    df = with_helpers(raw.withColumn("_tie", tie).withColumn("_keep", F.coalesce(keep_condition(), F.lit(False))))
    shown = F.col("_keep") & (lo <= hi)
    return df.select(
        F.col("dcosId").alias("sid"), *by, epoch_micros("lastUpdate").alias("at"), F.col("_tie").alias("tie"),
        F.when(shown, lo).otherwise(0).cast("long").alias("lo"), F.when(shown, hi).otherwise(-1).cast("long").alias("hi"),
        F.col("true_peakPower_W").cast("double").alias("w"))


def _lists(r, held, sign: int, by) -> list:
    """Change points of a range that goes on (``sign`` 1) or is taken back (-1), as structs."""
    w = F.coalesce(r["w"], F.lit(0.0))
    powered = F.when(r["w"].isNotNull(), 1).otherwise(0)
    return [F.when(held & (r["lo"] <= r["hi"]), F.struct(
        *[r[c].alias(c) for c in by], at.cast("long").alias("slot"), (w * s).alias("watts"),
        F.lit(s).cast("long").alias("sessions"), (powered * s).cast("long").alias("powered")))
        for at, s in ((r["lo"], sign), (r["hi"] + 1, -sign))]


def change_points(merged: DataFrame, by=()) -> DataFrame:
    """Merged sessions (:func:`merge_reports`) -> change points (by..., slot, watts, sessions, powered)."""
    new = F.col("is_new")
    points = (_lists(F.col("newest"), new, 1, by) + _lists(F.col("held"), new & F.col("held").isNotNull(), -1, by))
    return merged.select(F.explode(F.array_compact(F.array(*points))).alias("_p")).select("_p.*")


def merge_reports(ranges: DataFrame, held: DataFrame | None, by=()) -> DataFrame:
    """(sid, own, newest, held, is_new): each session of a batch or of the state, with its newest report.

    One shuffle by session: the largest (time, tie) of the batch's reports and
    the one that is held.  Reports without an id are sessions of their own.
    """
    report = F.struct("at", "tie", "lo", "hi", "w", *by)
    own = F.when(F.col("sid").isNull(), F.monotonically_increasing_id())
    rows = ranges.select("sid", own.alias("own"), report.alias("new"), F.lit(None).cast(_struct(ranges, by)).alias("held"))
    if held is not None:
        none = F.lit(None).cast(_struct(ranges, by))
        rows = rows.unionByName(held.select("sid", F.lit(None).cast("long").alias("own"), none.alias("new"),
                                            F.col("newest").alias("held")))
    both = rows.groupBy("sid", "own").agg(F.max("new").alias("new"), F.max("held").alias("held"))
    order = [F.struct(F.col(f"{c}.at"), F.col(f"{c}.tie")) for c in ("new", "held")]
    is_new = F.col("new").isNotNull() & (F.col("held").isNull() | (order[0] > order[1]))
    return both.select("sid", "own", F.when(is_new, F.col("new")).otherwise(F.col("held")).alias("newest"), "held",
                       is_new.alias("is_new"))


def _struct(ranges: DataFrame, by) -> T.StructType:
    return ranges.select(F.struct("at", "tie", "lo", "hi", "w", *by).alias("r")).schema["r"].dataType


def _milliseconds(keep: str) -> int:
    n, unit = keep.split()
    return int(n) * {"minutes": 60, "hours": 3600, "days": 86400}[unit.rstrip("s") + "s"] * 1000


def merge_batch(spark: SparkSession, ranges: DataFrame, state: str, epoch: int, by=(), keep: str = KEEP) -> DataFrame:
    """Bring the sessions' newest reports under ``state`` up to date with a batch; gives the merged sessions.

    Each batch reads its predecessor's folder and writes its own, so a replay
    does the same again; folders before that go.  ``seen`` holds the newest
    time of all reports (milliseconds), and what it was a batch before: reports
    that lie ``keep`` behind the latter are late, sessions that lie twice that
    behind the former hold no state any more.
    """
    keep_ms, last = _milliseconds(keep), epoch - 1
    seen = spark.read.parquet(f"{state}/seen/batch={last}").first() if path_exists(spark, f"{state}/seen/batch={last}") else None
    held = None
    if seen is not None:
        if seen.before is not None:
            ranges = ranges.filter(F.col("at").isNull() | (F.col("at") > (seen.before - keep_ms) * 1000))
        held = spark.read.parquet(f"{state}/sessions/batch={last}").filter("sid IS NOT NULL")
    merged = merge_reports(ranges, held, by)
    if seen is not None and seen.newest is not None:   # its time is over: as a change it is still written, but not held again
        gone = F.floor(F.col("newest.at") / 1000) + 2 * keep_ms <= seen.newest
        merged = merged.withColumn("held_on", F.col("sid").isNotNull() & ~F.coalesce(gone, F.lit(True)))
    else:
        merged = merged.withColumn("held_on", F.col("sid").isNotNull() & F.col("newest.at").isNotNull())
    path = f"{state}/sessions/batch={epoch}"
    merged.filter("is_new OR held_on").write.mode("overwrite").parquet(path)
    merged = spark.read.parquet(path)
    newest = merged.agg(F.floor(F.max("newest.at") / 1000).cast("long").alias("n"))
    before = F.lit(seen.newest if seen is not None else None).cast("long")
    (newest.select(F.greatest("n", before).alias("newest"), before.alias("before"))
     .write.mode("overwrite").parquet(f"{state}/seen/batch={epoch}"))
    for kind in ("sessions", "seen"):
        remove_path(spark, f"{state}/{kind}/batch={epoch - 2}")
    return merged


def run_demand_changes(spark: SparkSession, raw_stream: DataFrame, path: str | None = None, by=(), keep: str = KEEP,
                       checkpoint: str | None = None, state_partitions: int | None = None) -> str:
    """Write the change points of all that the source has (``availableNow``); returns their folder.

    The sessions' state lies beside the checkpoint.  ``state_partitions``: shuffle
    partitions of the batches (the session's setting by default).
    """
    path = path or scratch_path(spark, "demand-changes")
    checkpoint = checkpoint or scratch_path(spark, "demand-changes-ckpt")
    by = list(by)

    def write(batch: DataFrame, epoch: int) -> None:
        merged = merge_batch(spark, batch, f"{checkpoint}-state", epoch, by, keep)
        sums = change_points(merged, by).groupBy(*by, "slot").agg(*[F.sum(f.name).alias(f.name) for f in _MEASURES])
        (sums.filter("watts <> 0 OR sessions <> 0 OR powered <> 0")
             .write.mode("overwrite").parquet(f"{path}/batch={epoch}"))

    writer = (report_ranges(raw_stream, by).writeStream.outputMode("append").foreachBatch(write)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    start_with_state_partitions(spark, writer, state_partitions).awaitTermination()
    return path


def demand_curve(changes: DataFrame, as_of, by=()) -> DataFrame:
    """(by..., time, w, sessions, powered) for every slot from the first change to ``as_of``, empty ones too."""
    end = slot_index(as_ntz(as_of), STEP, "floor")
    names = [f.name for f in _MEASURES]
    wk = Window.partitionBy(*by).orderBy("slot")
    level = wk.rowsBetween(Window.unboundedPreceding, 0)
    points = (changes.filter(F.col("slot") <= end).groupBy(*by, "slot").agg(*[F.sum(c).alias(c) for c in names])
              .select(*by, "slot", *[F.sum(c).over(level).alias(c) for c in names]))
    points = points.withColumn("_first", F.min(F.when(F.col("sessions") > 0, F.col("slot"))).over(Window.partitionBy(*by)))
    filled = fill_forward(points.filter(F.col("slot") >= F.col("_first")), end, by)  # what came and was taken back goes
    return filled.select(*by, slot_time(F.col("_s"), STEP).alias("time"), F.col("watts").alias("w"), "sessions", "powered")


def closed_demand(changes: DataFrame, as_of, size_seconds: int = STEP, lag: str = "16 minutes", by=()) -> DataFrame:
    """(by..., time, power_W, energy_kWh) of the windows that end ``lag`` before the newest slot with a session.

    Only slots with a session count; a slot whose sessions all lack a power has none.
    """
    at = demand_curve(changes, as_of, by).filter("sessions > 0").withColumn("w", F.when(F.col("powered") > 0, F.col("w")))
    sums = (at.groupBy(*by, floor_time("time", size_seconds).alias("bucket"))
            .agg(F.sum("w").alias("power_W"), F.max("time").alias("_last")))
    newest = sums.agg(F.max("_last")).scalar()
    ends = F.timestamp_add("SECOND", F.lit(size_seconds), F.col("bucket"))
    return (sums.filter(ends <= newest - F.expr(f"INTERVAL {lag}"))
            .select(*by, F.col("bucket").alias("time"), "power_W", (F.col("power_W") / 12000.0).alias("energy_kWh")))
