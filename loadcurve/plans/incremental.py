"""C2-C5 kept up to date by change: demand tables maintained from a batch's change set.

Tables under one root, all partitioned by time:

* ``load`` (day): summed watts and sessions per (by..., slot), as far as any
  session reaches, after ``as_of`` too.  The change set's ``before`` rows are
  taken off and its ``after`` rows put on, for the days they touch only.  Rows
  carry the number of the batch that was applied last, so a replayed batch
  leaves a day alone that has it already.
* ``demand_5min`` (month, day): the gap-free curve, written anew for touched
  days, for days that a later ``as_of`` adds, and where a series' first slot has
  moved.
* ``demand_hourly`` (day) from those days, ``demand_daily`` and
  ``demand_monthly`` (month) from the touched months' 5-minute rows.
* ``spans``: first slot and ``as_of`` of each series, one folder a batch.

Session power is whole watts, so sums of differences are exact and the result
equals a refresh from all sessions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcurve.functions.timecols import as_ntz, slot_index, slot_time
from loadcurve.operators import rollup as R
from loadcurve.operators.clean import clean_sessions
from loadcurve.operators.timegrid import expand_slots
from loadcurve.session import materialize
from loadcurve.sources import tables as TB

SLOTS_A_DAY = 86400 // R.STEP
GRAINS = {"demand_5min": None, "demand_hourly": "hour", "demand_daily": "day", "demand_monthly": "month"}


def _day(slot) -> F.Column:
    return F.to_date(slot_time(slot, R.STEP))


def load_changes(changes: DataFrame, by=()) -> DataFrame:
    """A change set of raw sessions as (by..., day, slot, watts, sessions): what to add to the stored load."""
    cleaned = clean_sessions(changes)
    sign = F.when(F.col("change") == "after", 1).otherwise(-1)
    slots = expand_slots(cleaned, "startChargeTime", "finishChargeTime",
                         [*by, sign.alias("sessions"), (F.coalesce("true_peakPower_W", F.lit(0.0)) * sign).alias("watts")],
                         R.STEP, time_col=None)
    return (slots.groupBy(*by, "slot").agg(F.sum("watts").alias("watts"), F.sum("sessions").alias("sessions"))
            .select(*by, _day(F.col("slot")).alias("day"), "slot", "watts", "sessions"))


def _apply_load(spark: SparkSession, root: str, diffs: DataFrame, epoch: int, by) -> set[dt.date]:
    """Add the differences to the stored load; gives the days that they touch."""
    path = TB.table_path(root, "load")
    days = {r.day for r in diffs.select("day").distinct().collect()}   # one entry a calendar day
    todo, rows = days, diffs.withColumn("applied", F.lit(epoch).cast("long"))
    if TB.path_exists(spark, path):
        stored = spark.read.parquet(path).filter(F.col("day").isin(list(days)))
        done = {r.day for r in stored.groupBy("day").agg(F.max("applied").alias("a")).filter(F.col("a") >= epoch).collect()}
        todo = days - done
        rows = stored.unionByName(rows).filter(F.col("day").isin(list(todo)))
    if todo:
        sums = rows.groupBy(*by, "day", "slot").agg(*[F.sum(c).alias(c) for c in ("watts", "sessions")])
        sums = sums.withColumn("applied", F.lit(epoch).cast("long"))   # slots that are empty again stay, as do their days
        TB.replace_partitions(spark, sums, path, ["day"], [f"day={d.isoformat()}" for d in todo])
    return days


def _spans(spark: SparkSession, root: str, epoch: int, as_of, by) -> tuple[DataFrame, DataFrame | None]:
    """(by..., first, last) of each series now, and after the batch before (None: there was none)."""
    path = TB.table_path(root, "spans")
    older = [int(f.split("=")[1]) for f in TB.subfolders(spark, path)]
    older = [e for e in older if e < epoch]
    before = spark.read.parquet(f"{path}/batch={max(older)}") if older else None
    last = slot_index(as_ntz(as_of), R.STEP, "floor")
    load = spark.read.parquet(TB.table_path(root, "load")).filter("sessions > 0")
    now = load.groupBy(*by).agg(F.min("slot").alias("first")).filter("first IS NOT NULL").withColumn("last", last)
    now.filter(F.col("first") <= F.col("last")).write.mode("overwrite").parquet(f"{path}/batch={epoch}")
    return spark.read.parquet(f"{path}/batch={epoch}"), before


def _moved_days(now: DataFrame, before: DataFrame | None, by) -> set[dt.date]:
    """Days between old and new ends of the series, both included."""
    names = list(by)
    if before is None:
        ends = [now.select(F.col("first").alias("lo"), F.col("last").alias("hi"))]
    else:
        old = before.select(*names, F.col("first").alias("f0"), F.col("last").alias("l0"))
        both = now.join(old, names, "full") if names else now.withColumn("_k", F.lit(1)).join(
            old.withColumn("_k", F.lit(1)), "_k", "full")
        whole = F.col("first").isNull() | F.col("f0").isNull()
        ends = [both.filter(whole).select(F.coalesce("first", "f0").alias("lo"), F.coalesce("last", "l0").alias("hi"))]
        for a, b in (("first", "f0"), ("last", "l0")):
            ends.append(both.filter(~whole & (F.col(a) != F.col(b)))
                        .select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))
    days = set()
    for e in ends:
        lo, hi = (F.floor(F.col(c) / F.lit(SLOTS_A_DAY)) for c in ("lo", "hi"))
        found = e.select(F.explode(F.sequence(lo.cast("long"), hi.cast("long"))).alias("d")).distinct().collect()
        days |= {dt.date(1970, 1, 1) + dt.timedelta(days=r.d) for r in found}
    return days


def refresh_changed(spark: SparkSession, root: str, changes: DataFrame, epoch: int, as_of, by=()) -> list[dt.date]:
    """Bring the tables under ``root`` up to date with one batch's change set; gives the rewritten days.

    ``changes`` are raw session columns with ``change`` ('before' or 'after');
    batches come in the order of ``epoch``, and one may be replayed.
    """
    by = list(by)
    days = _apply_load(spark, root, materialize(load_changes(changes, by)), epoch, by)
    if not TB.path_exists(spark, TB.table_path(root, "load")):
        return []
    now, before = _spans(spark, root, epoch, as_of, by)
    days = sorted(days | _moved_days(now, before, by))
    if not days:
        return []
    dates, months = [d.isoformat() for d in days], sorted({d.isoformat()[:7] for d in days})
    first_slots = F.array(*[F.lit((d - dt.date(1970, 1, 1)).days * SLOTS_A_DAY).cast("long") for d in days])
    lo, hi = F.greatest("first", "_d"), F.least("last", F.col("_d") + SLOTS_A_DAY - 1)
    spine = (now.withColumn("_d", F.explode(first_slots)).filter(lo <= hi)
             .select(*by, F.explode(F.sequence(lo, hi)).alias("slot")))
    load = spark.read.parquet(TB.table_path(root, "load")).filter(F.col("day").isin(days)).select(*by, "slot", "watts")
    watts = spine.join(load, [*by, "slot"], "left").select(
        *by, slot_time(F.col("slot"), R.STEP).alias("time"), F.coalesce("watts", F.lit(0.0)).alias("w"))
    d5 = R.demand_features(watts, by).withColumns(
        {"ym": F.date_format("time", "yyyy-MM"), "on_day": F.date_format("time", "yyyy-MM-dd")})
    TB.replace_partitions(spark, d5, TB.table_path(root, "demand_5min"), ["ym", "on_day"],
                          [f"ym={d[:7]}/on_day={d}" for d in dates])
    stored = spark.read.schema(d5.schema).parquet(TB.table_path(root, "demand_5min"))   # it may have no row yet
    in_days = stored.filter(F.col("on_day").cast("string").isin(dates)).drop("ym", "on_day")
    in_months = stored.filter(F.col("ym").cast("string").isin(months)).drop("ym", "on_day")
    hourly = R.rollup(in_days, "hour", by).withColumn("on_day", F.date_format("time", "yyyy-MM-dd"))
    TB.replace_partitions(spark, hourly, TB.table_path(root, "demand_hourly"), ["on_day"], [f"on_day={d}" for d in dates])
    for name in ("demand_daily", "demand_monthly"):
        rolled = R.rollup(in_months, GRAINS[name], by).withColumn("ym", F.date_format("time", "yyyy-MM"))
        TB.replace_partitions(spark, rolled, TB.table_path(root, name), ["ym"], [f"ym={m}" for m in months])
    return days


def read_demand(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the maintained tables without its partition columns."""
    df = spark.read.parquet(TB.table_path(root, name))
    return df.drop("ym", "on_day")
