"""Session upserts -- a session is re-reported until it ends.

The session table is partitioned by connect day.  Each micro-batch first
becomes a *change set*: for every session whose newest report changes, the
stored row (``before``, if there is one) and the new one (``after``).  It is
written under the batch's number and is the log that everything else follows:

* the touched days of the session table are rewritten without the change set's
  sessions and with their ``after`` rows (dynamic partition overwrite; a day
  that loses its last session is removed);
* an index of (session, day), one folder a batch, says where a session is
  stored, so a report with another connect day also finds the old one;
* ``plans/incremental`` keeps the demand tables up to date from it.

A replayed batch finds its change set and applies it once more with the same
result.  Rows without an id are sessions of their own: all are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadcurve.session import scratch_path
from loadcurve.sources.tables import path_exists, remove_path, replace_partitions, subfolders

KEY = "dcosId"
SESSION = "session_key"      # the id as text, or a name of its own for a row without one
NO_DAY = "1970-01-01"        # partition of rows without a connect time
INDEX_BATCHES = 50           # folders of the index before it is written as one


def latest_reports(df: DataFrame, *prefer) -> DataFrame:
    """Newest report per session: ``row_number() == 1`` (a ``WindowGroupLimit``, so
    each task keeps one row per session before the shuffle); equal report times
    are ordered by a hash of the whole row, so replays pick the same row."""
    values = [c for c in df.columns if c not in (SESSION, "day", "_stored")]
    w = Window.partitionBy(SESSION).orderBy(F.col("lastUpdate").desc(), F.xxhash64(*values), *prefer)
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1).drop("_rk")


def _named(batch: DataFrame, epoch: int, day_col: str) -> DataFrame:
    own = F.concat(F.lit(f"row-{epoch}-"), F.monotonically_increasing_id().cast("string"))
    return (batch.withColumn(SESSION, F.coalesce(F.col(KEY).cast("string"), own))
            .withColumn("day", F.coalesce(F.to_date(day_col), F.lit(NO_DAY).cast("date"))))


def _days(df: DataFrame) -> list:
    """The distinct days of a frame: a bounded list, one entry per calendar day."""
    return [r.day for r in df.select("day").distinct().collect()]


def _stored(spark: SparkSession, target: str, days: list, like: DataFrame) -> DataFrame:
    """The stored sessions of ``days``, with the columns of ``like``.

    The table may have none of them, or no day at all yet: a batch without rows
    leaves a folder that no schema can be read from.
    """
    there = set(subfolders(spark, target))
    paths = [f"{target}/day={d.isoformat()}" for d in days if f"day={d.isoformat()}" in there]
    return spark.read.schema(like.schema).option("basePath", target).parquet(*paths) if paths else like.limit(0)


def change_set(spark: SparkSession, target: str, epoch: int) -> DataFrame:
    """The change set of a batch: the session's columns, ``session_key``, ``day`` and ``change``."""
    return spark.read.parquet(f"{target}-changes/batch={epoch}")


def log_changes(spark: SparkSession, batch: DataFrame, target: str, epoch: int, day_col: str = "connectTime") -> None:
    """Write the batch's change set, unless a whole one is there already."""
    path = f"{target}-changes/batch={epoch}"
    if path_exists(spark, f"{path}/_SUCCESS"):
        return
    named = f"{target}-staging/reports-{epoch}"   # names are given once
    latest_reports(_named(batch, epoch, day_col)).write.mode("overwrite").parquet(named)
    new = spark.read.parquet(named)
    if path_exists(spark, f"{target}-index"):
        at = spark.read.parquet(f"{target}-index").filter(F.col("batch") < epoch).join(
            new.select(SESSION), SESSION, "left_semi").groupBy(SESSION).agg(F.max_by("day", "batch").alias("day"))
        stored = _stored(spark, target, _days(at), new).join(new.select(SESSION), SESSION, "left_semi")
        both = stored.withColumn("_stored", F.lit(1)).unionByName(new.withColumn("_stored", F.lit(0)))
        after = latest_reports(both, F.col("_stored").desc()).filter("_stored = 0").drop("_stored")
        before = stored.join(after.select(SESSION), SESSION, "left_semi")
        log = after.withColumn("change", F.lit("after")).unionByName(before.withColumn("change", F.lit("before")))
    else:
        log = new.withColumn("change", F.lit("after"))
    log.write.mode("overwrite").parquet(path)
    remove_path(spark, named)


def apply_changes(spark: SparkSession, target: str, epoch: int) -> None:
    """Rewrite the touched days of the session table from the change set, then note where its sessions are."""
    log = change_set(spark, target, epoch)
    after, days = log.filter("change = 'after'").drop("change"), _days(log)
    kept = _stored(spark, target, days, after).join(log.select(SESSION).distinct(), SESSION, "left_anti")
    replace_partitions(spark, kept.unionByName(after), target, ["day"], [f"day={d.isoformat()}" for d in days])
    index = f"{target}-index"
    after.select(SESSION, "day").write.mode("overwrite").parquet(f"{index}/batch={epoch}")
    older = [f for f in subfolders(spark, index) if int(f.split("=")[1]) < epoch]
    if len(older) >= INDEX_BATCHES:   # a session's day is that of its last batch, so both forms say the same
        newest = (spark.read.parquet(index).filter(F.col("batch") <= epoch)
                  .groupBy(SESSION).agg(F.max_by("day", "batch").alias("day")))
        staged = f"{target}-staging/index-{epoch}"
        newest.write.mode("overwrite").parquet(staged)
        spark.read.parquet(staged).write.mode("overwrite").parquet(f"{index}/batch={epoch}")
        for f in [f"{index}/{f}" for f in older] + [staged]:
            remove_path(spark, f)


def merge_batch(spark: SparkSession, batch: DataFrame, target: str, epoch: int = 0,
                day_col: str = "connectTime") -> None:
    log_changes(spark, batch, target, epoch, day_col)
    apply_changes(spark, target, epoch)


def run_upsert_stream(spark: SparkSession, reports: DataFrame, target: str | None = None,
                      checkpoint: str | None = None, after: Callable[[int], None] | None = None) -> str:
    """Upsert all reports that the source has; ``after(epoch)`` runs once a batch is merged."""
    target = target or scratch_path(spark, "sessions-upsert")
    checkpoint = checkpoint or scratch_path(spark, "sessions-upsert-ckpt")

    def merge(batch: DataFrame, epoch: int) -> None:
        merge_batch(spark, batch, target, epoch)
        if after:
            after(epoch)

    q = (reports.writeStream.foreachBatch(merge)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return target
