"""Exact running totals over one global order, without a single-task window.

``Window.orderBy(...)`` with no partition puts every row in one task.

*Prefix sums by slice* (``slice_``, a whole number that does not fall along the
order, say the hour of the first key).  The rows are dealt by slice once; a
window gives the running sum inside each slice, and the last one is the slice's
total.  Totals are a row per slice, bounded by the time span: running sums of
them, within groups of slices and over the groups, are joined back on
the slice, on which the rows are dealt already.  Rows and totals need the same
columns of the same exchange, so Spark reads the input once (``ReusedExchange``).

*Ranges* (no ``slice_``), for any order: the frame is range-partitioned on the order keys (balanced by sampling, so a
busy period is split across tasks), each range computes its local running
sum, and the totals of the preceding ranges -- one row per range, a proven
small table -- are broadcast back as offsets.  Result: the same numbers as a
global window, with work spread over all tasks.

The range id is a physical property (``spark_partition_id`` after the range
exchange), and Catalyst prunes the two consumers differently, which would
plan two exchanges with different sampled bounds.  So the tagged frame is
written once with ``checkpoint()`` (to the shared ``spark.checkpoint.dir``);
both the local sums and the range totals read that same copy, and a lost
executor re-reads it instead of re-sampling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcurve.functions.timecols import slot_index
from loadcurve.session import checkpoint_dir


GROUP_BITS = 10   # 2 ** GROUP_BITS slices' totals are summed in one task
NO_TIME = -(1 << 40)


def time_slice(col: str, seconds: int = 3600) -> Column:
    """The slice of a time (null times come first)."""
    return F.coalesce(slot_index(col, seconds, "floor"), F.lit(NO_TIME).cast("long"))


def _sliced_running_sum(df: DataFrame, order: list[Column], value: Column, out_col: str, slice_: Column) -> DataFrame:
    rows = df.withColumn("_slice", slice_).repartition("_slice")
    w = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum(value).over(w))
    totals = (local.withColumn("_rn", F.row_number().over(Window.partitionBy("_slice").orderBy(*order)))
              .groupBy("_slice").agg(F.max_by("_local", "_rn").alias("_tot"))
              .withColumn("_group", F.shiftright("_slice", GROUP_BITS)))
    earlier = lambda w, key: w.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.groupBy("_group").agg(F.sum("_tot").alias("_sum"))
    groups = groups.select("_group", F.coalesce(F.sum("_sum").over(earlier(Window, "_group")), F.lit(0)).alias("_base"))
    offsets = (totals.withColumn("_prior", F.coalesce(
                   F.sum("_tot").over(earlier(Window.partitionBy("_group"), "_slice")), F.lit(0)))
               .join(groups, "_group").select("_slice", (F.col("_base") + F.col("_prior")).alias("_off")))
    return (local.join(offsets, "_slice").withColumn(out_col, F.col("_local") + F.col("_off"))
            .drop("_slice", "_local", "_off"))


def global_running_sum(df: DataFrame, order: list[Column], value: Column, out_col: str,
                       slice_: Column | None = None, num_ranges: int | None = None) -> DataFrame:
    if slice_ is not None:
        return _sliced_running_sum(df, order, value, out_col, slice_)
    spark = df.sparkSession
    n = num_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    checkpoint_dir(spark)
    tagged = (df.withColumn("_v", value)
                .repartitionByRange(n, *order)
                .withColumn("_rng", F.spark_partition_id())
                .checkpoint(eager=True))
    w = Window.partitionBy("_rng").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_local", F.sum("_v").over(w))
    # one row per range: total of that range, then the sum of all earlier ranges
    totals = local.groupBy("_rng").agg(F.sum("_v").alias("_tot"))
    prior = Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_rng", F.coalesce(F.sum("_tot").over(prior), F.lit(0)).alias("_off"))
    return (local.join(F.broadcast(offsets), "_rng")
                 .withColumn(out_col, F.col("_local") + F.col("_off"))
                 .drop("_v", "_rng", "_local", "_off"))


def global_row_number(df: DataFrame, order: list[Column], out_col: str = "rn",
                      slice_: Column | None = None, num_ranges: int | None = None) -> DataFrame:
    """1..n in the given (unique) order."""
    return global_running_sum(df, order, F.lit(1).cast("long"), out_col, slice_, num_ranges)
