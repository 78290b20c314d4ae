"""Every registered query against its DuckDB oracle (the driver's check, at sf0.001)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loadcurve.plans.registry import ORACLE, QUERIES
from conftest import SF_SMALL

TABLES = ["events", "orders"]
NAMES = sorted(ORACLE)   # the training-data operators have tests of their own


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~null"
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    return v.isoformat() if hasattr(v, "isoformat") else v


def _rows(pdf):
    import pandas as pd
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(None if (not isinstance(x, str) and pd.isna(x)) else x) for x in r)
                         for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert _rows(got) == _rows(want)


def test_every_query_has_a_callable_and_rows_only_ones_run(spark):
    qs = entry.queries()
    for name in set(QUERIES) - set(ORACLE):
        assert qs[name](spark, SF_SMALL).count() >= 1


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"time", "avg_power_demand_kW", "energy_demand_kWh", "peak_power_kW", "day", "month"} <= set(df.columns)
