"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.operators.clean import clean_sessions
from loadcurve.session import ensure_defaults
from loadcurve.sources import fixtures

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column half-to-even (engines differ in the last bits of sums)."""
    return df.select(*[F.bround(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_defaults(spark)
    return fixtures.sessions_raw(spark, sf_dir)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_sessions(raw(spark, sf_dir))
