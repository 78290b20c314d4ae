"""End-to-end jobs: refresh, hourly / daily forecast, parameter update.

``refresh`` reads the raw sessions **once**, into ``reports`` (rows that either
cleaning path keeps, partitioned by connect day, in the shared folder); every
product is computed from that written copy and written as a named table.  The
rules of ``RULES`` say what hangs on what; a job whose table is missing builds
it, and only what it needs (``manifest``).

Forecast jobs read the stored hourly / daily tables, melt the quantities to
rows (``quantity`` becomes a series key), and fit every quantity and every
series in one job, each with its own stored parameters; then they merge with
the stored forecasts (upsert).  ``update_params`` searches both tables'
parameters, clears the forecasts and makes them anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcurve.operators import analytics as A
from loadcurve.operators import clean as C
from loadcurve.operators import forecasts as FC
from loadcurve.operators import knn as KN
from loadcurve.operators import rollup as R
from loadcurve.operators import seasonal as SE
from loadcurve.operators import status as ST
from loadcurve.operators import today as TD
from loadcurve.plans.manifest import Rule, Site
from loadcurve.schemas import PERSONAL_COLUMNS, QUANTITIES
from loadcurve.session import materialize
from loadcurve.sources import tables as TB

# Fixed values of the reference's parameter search (hourly kNN).
KNN_DEPTHS = list(range(40, 61))
KNN_KS = list(range(10, 26))
DAILY_ORDERS = (2, 2)   # largest p and P of the daily search


GRAINS = {"demand_hourly": "hour", "demand_daily": "day", "demand_monthly": "month"}


def _reports(site: Site) -> None:
    """Raw sessions that a cleaning path keeps, with a flag for each path: the one read of the source."""
    flags = {"_full": F.coalesce(C.keep_condition(), F.lit(False)),
             "_today": F.coalesce(C.keep_condition(24.0, 1, "first_char"), F.lit(False))}
    rows = site.raw.withColumns(flags).filter("_full OR _today").drop(*PERSONAL_COLUMNS)
    site.write(rows.withColumn("_day", F.to_date("connectTime")), "reports", ["_day"])


def _sessions(site: Site) -> None:
    rows = C.with_helpers(site.read("reports").filter("_full").drop("_full", "_today", "_day"))
    site.write(rows.withColumn("_day", F.to_date("connectTime")), "sessions", ["_day"])


def _todays(site: Site) -> None:
    raw = site.read("reports").filter("_today").drop("_full", "_today", "_day")
    site.write(TD.todays_sessions(raw, site.settings["as_of"]), "todays_sessions")


def _demand_5min(site: Site) -> None:
    d5 = R.demand_5min(site.read("sessions"), site.settings["as_of"], site.by)
    site.write(d5.withColumn("ym", F.date_format("time", "yyyy-MM")), "demand_5min", ["ym"])


def _rollup(name: str) -> Rule:
    return Rule(("demand_5min",), lambda site: site.write(
        R.rollup(site.read("demand_5min").drop("ym"), GRAINS[name], site.by), name))


def _hourly_params(site: Site) -> None:
    """Best (depth, k) per series for energy and peak; average power reuses energy's (M4)."""
    long = melt(site.read("demand_hourly"), site.by, ("energy_demand_kWh", "peak_power_kW"))
    best = KN.knn_grid_search(long, site.settings.get("depths") or KNN_DEPTHS, site.settings.get("ks") or KNN_KS,
                              "v", [*site.by, "quantity"])
    params = (best.select(F.lit("knn").alias("model"), F.lit("hourly").alias("series"), *site.by, "quantity",
                          "best_depth", "best_n_neighbors"))
    params = params.unionByName(params.filter(F.col("quantity") == "energy_demand_kWh")
                                .withColumn("quantity", F.lit("avg_power_demand_kW")))
    TB.save_params(params, site.root, by=site.by)


def _daily_params(site: Site) -> None:
    """Orders of the daily model with the least AIC, per series and quantity."""
    most = site.settings.get("orders") or DAILY_ORDERS
    best = SE.seasonal_order_search(melt(site.read("demand_daily"), site.by), *most, "v", [*site.by, "quantity"])
    site.write(best.select(F.lit("seasonal").alias("model"), F.lit("daily").alias("series"), *site.by, "quantity",
                           "ar_order", "seasonal_ar_order", "aic"), "seasonal_params")


RULES: dict[str, Rule] = {
    "reports": Rule(("source",), _reports),
    "sessions": Rule(("reports",), _sessions),
    "sessions_subset": Rule(("sessions",), lambda s: s.write(C.session_subset(s.read("sessions")), "sessions_subset")),
    "chargers": Rule(("sessions",), lambda s: s.write(
        ST.charger_status(s.read("sessions").drop("_day"), s.settings["as_of"]), "chargers"), ("as_of",)),
    "demand_5min": Rule(("sessions",), _demand_5min, ("as_of",)),
    **{name: _rollup(name) for name in GRAINS},
    "todays_sessions": Rule(("reports",), _todays, ("as_of",)),
    "user_profiles": Rule(("sessions_subset",), lambda s: s.write(A.user_profile(s.read("sessions_subset")),
                                                                  "user_profiles")),
    "knn_params": Rule(("demand_hourly",), _hourly_params, follows=False),
    "seasonal_params": Rule(("demand_daily",), _daily_params, follows=False),
}
PRODUCTS = [name for name, rule in RULES.items() if rule.follows]


def open_site(spark: SparkSession, root: str, by=(), raw: DataFrame | None = None, **settings) -> Site:
    """The site under ``root`` with the settings of its last refresh, and these beside them."""
    site = Site(spark, root, RULES, list(by), raw)
    site.settings = site.noted("refresh") | {k: v for k, v in settings.items() if v is not None}
    return site


def refresh(spark: SparkSession, raw: DataFrame, root: str, as_of, by=(), source_version: str | None = None) -> dict[str, str]:
    """Derive every table from the source, write them; returns name -> path.

    ``source_version`` names the state of the source (by default each call is
    a new one); tables whose inputs have the version they had are not built again.
    """
    noted = {"as_of": str(as_of), "source_version": source_version or uuid.uuid4().hex}
    site = open_site(spark, root, by, raw, **noted)
    site.note("refresh", noted)
    for name in PRODUCTS:
        site.ensure(name)
    return {name: TB.table_path(root, name) for name in PRODUCTS}


def melt(table: DataFrame, by=(), quantities=QUANTITIES, value_col: str = "v") -> DataFrame:
    """Quantities as rows: (by..., quantity, time, v)."""
    stack = F.explode(F.array(*[F.struct(F.lit(q).alias("quantity"), F.col(q).alias(value_col))
                                for q in quantities])).alias("_q")
    return table.select(*by, "time", stack).select(*by, "_q.quantity", "time", f"_q.{value_col}")


def unmelt(long: DataFrame, by=(), value_col: str = "v_predictions") -> DataFrame:
    """Back to one ``<quantity>_predictions`` column per quantity (bounded pivot values)."""
    wide = long.groupBy(*by, "time").pivot("quantity", list(QUANTITIES)).agg(F.first(value_col))
    return wide.select(*by, "time", *[F.col(q).alias(q + "_predictions") for q in QUANTITIES])


def update_params(spark: SparkSession, root: str, depths=None, ks=None, by=(), orders=None,
                  raw: DataFrame | None = None, refit: bool = True) -> DataFrame:
    """Monthly: search hourly and daily parameters anew; ``refit`` clears the forecasts and makes them again.

    Gives the stored hourly parameters.
    """
    site = open_site(spark, root, by, raw, depths=depths, ks=ks, orders=orders)
    site.rebuild("seasonal_params")
    site.rebuild("knn_params")
    if refit:
        for name in ("daily_forecasts", "hourly_forecasts"):
            TB.remove_path(spark, TB.table_path(root, name))
        forecast_daily(spark, root, by=by)
        forecast_hourly(spark, root, by=by)
    return TB.load_params(spark, root, "knn", "hourly")


def _merged(spark: SparkSession, root: str, name: str, new: DataFrame, freq: str, by) -> DataFrame:
    """The stored forecasts (none yet: the empty table) with a new run merged in, per series."""
    existing = (TB.read_table(spark, name, root) if TB.table_exists(spark, name, root)
                else FC.empty_forecasts(spark, [new.schema[c] for c in by]))
    return FC.upsert_forecasts(existing, new, freq, by)


def forecast_hourly(spark: SparkSession, root: str, depth: int | None = None, k: int | None = None, by=(),
                    raw: DataFrame | None = None, **search) -> DataFrame:
    """Hourly kNN forecast of every quantity and series, merged into the stored forecasts and clamped.

    Without ``depth`` and ``k`` each series takes its stored parameters; missing
    ones are searched first (``search``: ``depths``, ``ks``), and a missing demand
    table is built, from ``raw`` if it comes to that.
    """
    site = open_site(spark, root, by, raw, **search)
    if depth is None:
        site.ensure("knn_params")
    site.ensure("demand_hourly") if site.noted("refresh") else None
    long = melt(site.read("demand_hourly"), by)
    if depth is None:
        preds = KN.knn_forecast_by_params(long, TB.load_params(spark, root, "knn", "hourly"), "v", [*by, "quantity"])
    else:
        preds = KN.knn_forecast(long, depth, k, "v", [*by, "quantity"])
    merged = materialize(FC.clamp_hourly(_merged(spark, root, "hourly_forecasts", unmelt(preds, by), "hour", by)))
    TB.write_table(merged, "hourly_forecasts", root)
    return TB.read_table(spark, "hourly_forecasts", root)


def forecast_daily(spark: SparkSession, root: str, p: int | None = None, P: int | None = None, by=(),
                   raw: DataFrame | None = None, **search) -> DataFrame:
    """Daily seasonal forecast (7 days) of every quantity and series, merged into the stored forecasts.

    Without ``p`` and ``P`` each series takes its stored orders; missing ones
    are searched first (``search``: ``orders``, the largest p and P).
    """
    site = open_site(spark, root, by, raw, **search)
    if p is None:
        site.ensure("seasonal_params")
    site.ensure("demand_daily") if site.noted("refresh") else None
    long = melt(site.read("demand_daily"), by)
    if p is None:
        preds = SE.seasonal_forecast_by_params(long, site.read("seasonal_params"), "v", [*by, "quantity"])
    else:
        preds = SE.seasonal_forecast(long, p, P, "v", [*by, "quantity"])
    merged = materialize(_merged(spark, root, "daily_forecasts", unmelt(preds, by), "day", by))
    TB.write_table(merged, "daily_forecasts", root)
    return TB.read_table(spark, "daily_forecasts", root)
