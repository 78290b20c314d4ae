"""Named tables, CSV, flattening and the parameter table.

Named tables are parquet directories under one root (a shared folder); the
reference's key-value blobs become ``overwrite`` writes, optionally
partitioned (e.g. the 5-minute table by month, so range reads prune whole
months).  Reading several tables is just several lazy DataFrames.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.schemas import KNN_PARAMS, SESSIONS_RAW


DATE_COLUMNS = tuple(f.name for f in SESSIONS_RAW.fields if isinstance(f.dataType, T.TimestampNTZType))
ID_COLUMNS = ("dcosId", "siteId", "stationId")
# without an offset, with one (``Z`` too; wall clock of UTC), and the American form
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX",
                "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX", "MM/dd/yyyy HH:mm:ss")


def table_path(root: str, name: str) -> str:
    return os.path.join(root, name)


def write_table(df: DataFrame, name: str, root: str, partition_by=None, mode: str = "overwrite") -> str:
    """S3: write (replace) a named table."""
    path = table_path(root, name)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_table(spark: SparkSession, name: str, root: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a named table (declared schema if given)."""
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.parquet(table_path(root, name))


def read_tables(spark: SparkSession, names: list[str], root: str) -> list[DataFrame]:
    """Several named tables, in the order asked."""
    return [read_table(spark, n, root) for n in names]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does a path exist (any Hadoop file system: local, HDFS, object stores)?"""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library has written (nothing happens if it is not there)."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder (none if it is not there)."""
    fs, p = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []


def data_files(spark: SparkSession, path: str) -> int:
    """How many data files a folder holds (markers and hidden files are none)."""
    fs, p = _file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isFile()]
    return sum(not n.startswith(("_", ".")) for n in names)


def replace_partitions(spark: SparkSession, df: DataFrame, path: str, partition_by: list[str], parts: list[str]) -> None:
    """Make ``df`` the whole content of the partitions ``parts`` (``col=value/...``) of a table it may be read from.

    The rows are written beside the table first, then over the partitions they
    belong to (dynamic overwrite); a partition of ``parts`` that got no rows is
    removed.  Other partitions keep their files.
    """
    staged = f"{path}-staging"
    df.write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(df.schema).parquet(staged)
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*partition_by).parquet(path))
    filled = {"/".join(f"{c}={r[c]}" for c in partition_by) for r in rows.select(*partition_by).distinct().collect()}
    for part in set(parts) - filled:
        remove_path(spark, f"{path}/{part}")
    remove_path(spark, staged)


def table_exists(spark: SparkSession, name: str, root: str) -> bool:
    """Does a named table exist?"""
    return path_exists(spark, table_path(root, name))


def scan_sessions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Full scan of a raw session table with the declared schema (splits replace pages)."""
    reader = spark.read.schema(SESSIONS_RAW)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def scan_session_texts(spark: SparkSession, path: str, fmt: str = "json", formats=DATE_FORMATS) -> DataFrame:
    """S1 over records whose dates and ids are text (P3, F4): read as strings, then parsed."""
    text = T.StructType([T.StructField(f.name, T.StringType()) if f.name in DATE_COLUMNS + ID_COLUMNS else f
                         for f in SESSIONS_RAW.fields])
    reader = spark.read.schema(text)
    if fmt == "csv":
        reader = reader.option("header", True)
    return parse_texts(reader.format(fmt).load(path), formats)


def parse_texts(raw: DataFrame, formats=DATE_FORMATS) -> DataFrame:
    """Text dates (first format that fits) and text ids with their declared types.

    Text that fits no format, or is no number, becomes null and so leaves the
    cleaned sessions; columns that are not text stay as they are.
    """
    parsed = {}
    for f in raw.schema.fields:
        col = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, T.StringType):
            continue
        if f.name in DATE_COLUMNS:
            parsed[f.name] = F.coalesce(*[F.try_to_timestamp(col, F.lit(x)) for x in formats]).cast("timestamp_ntz")
        elif f.name in ID_COLUMNS:
            parsed[f.name] = col.try_cast(SESSIONS_RAW[f.name].dataType)
    return raw.withColumns(parsed) if parsed else raw


def text_rejects(raw: DataFrame, formats=DATE_FORMATS) -> DataFrame:
    """One row: for each text date and id, how many values :func:`parse_texts` cannot read (blank ones are none)."""
    parsed = parse_texts(raw.select([F.col(f"`{c}`") for c in raw.columns] + [
        F.col(f"`{f.name}`").alias(f"_text_{f.name}") for f in raw.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name in DATE_COLUMNS + ID_COLUMNS]), formats)
    texts = [c for c in parsed.columns if c.startswith("_text_")]
    return parsed.agg(*[F.count_if((F.trim(F.col(f"`{c}`")) != "") & F.col(f"`{c[6:]}`").isNull()).alias(c[6:])
                        for c in texts])


def write_csv(df: DataFrame, path: str) -> str:
    """CSV export with a header line."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV import with declared types (no inference pass over the data)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def parse_json(df: DataFrame, col: str, schema: str | T.StructType) -> DataFrame:
    """JSON text column -> struct column (malformed text gives null)."""
    return df.withColumn(col, F.from_json(F.col(col), schema))


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs -> one column per leaf, named by the dotted path."""
    cols = []

    def walk(prefix: list[str], dtype):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(prefix + [f.name], f.dataType)
        else:
            ref = F.col(".".join(f"`{p}`" for p in prefix))
            cols.append(ref.alias(sep.join(prefix)))

    for f in df.schema.fields:
        walk([f.name], f.dataType)
    return df.select(*cols)


def save_params(params: DataFrame, root: str, name: str = "knn_params", by=()) -> str:
    """Store a parameter table (model, series, by..., quantity, best_depth, best_n_neighbors)."""
    first, rest = KNN_PARAMS.fieldNames()[:2], KNN_PARAMS.fieldNames()[2:]
    return write_table(params.select(*first, *by, *rest), name, root)


def load_params(spark: SparkSession, root: str, model: str, series: str | None = None,
                name: str = "knn_params") -> DataFrame:
    """The stored parameters of a model, with the series keys that they were stored with."""
    p = read_table(spark, name, root).filter(F.col("model") == model)
    return p if series is None else p.filter(F.col("series") == series)
