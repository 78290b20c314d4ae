"""Streaming readers over files (one parquet file, or a folder that grows)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int | None = None,
                fmt: str = "parquet") -> DataFrame:
    """A file stream over ``path``; a single file is read through a one-file glob."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if os.path.isfile(path):
        base, name = os.path.split(path)
        return r.option("basePath", base).load(os.path.join(base, name[:-1] + f"[{name[-1]}]"))
    return r.load(path)


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def start_with_settings(spark: SparkSession, writer, settings: dict[str, str], state_partitions: int | None = None):
    """Start a streaming query under ``settings`` of its own.

    A query takes a copy of the session settings at ``start()``, so they are
    changed only around that call.  The number of state partitions is fixed
    when a query first starts (it comes from ``spark.sql.shuffle.partitions``
    and is kept in the checkpoint).
    """
    if state_partitions:
        settings = settings | {"spark.sql.shuffle.partitions": str(state_partitions)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start_with_state_partitions(spark: SparkSession, writer, state_partitions: int | None):
    """Start a streaming query whose state store gets ``state_partitions`` partitions."""
    return start_with_settings(spark, writer, {}, state_partitions)
