"""Session analytics.

No operator sorts the whole table in one task: running totals use the
prefix sums by slice of ``ordered.py``; profiles and counts are
partial-aggregated ``groupBy``s.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadcurve.functions.scalars import part_of_day
from loadcurve.functions.timecols import as_ntz, day_start
from loadcurve.operators.explore import between_dates
from loadcurve.operators.ordered import global_running_sum, time_slice


def cumulative_energy(sessions: DataFrame, start=None, end=None, grain: str | None = None) -> DataFrame:
    """Running kWh by finish time; the date filter comes first.

    A session without energy keeps a null at its own row (pandas ``cumsum``)
    and adds nothing to the total.  ``grain="day"`` gives one row per day
    instead: daily sums (partial-aggregated), then the running sum over days.
    """
    s = between_dates(sessions.select("dcosId", "finishChargeTime", "cumEnergy_Wh"),
                      "finishChargeTime", start, end)
    if grain == "day":
        daily = s.groupBy(day_start("finishChargeTime").alias("day")).agg(
            F.coalesce(F.sum("cumEnergy_Wh"), F.lit(0.0)).alias("_wh"))
        run = global_running_sum(daily, [F.col("day")], F.col("_wh"), "_run", time_slice("day", 86400 * 30))
        return run.select("day", (F.col("_run") / 1000).alias("cum_energy_kWh"))
    if grain is not None:
        raise ValueError(f"unknown grain {grain!r}")
    run = global_running_sum(s, [F.col("finishChargeTime"), F.col("dcosId")],
                             F.coalesce(F.col("cumEnergy_Wh"), F.lit(0.0)), "_run", time_slice("finishChargeTime"))
    return run.select("dcosId", "finishChargeTime",
                      F.when(F.col("cumEnergy_Wh").isNotNull(), F.col("_run") / 1000).alias("cum_energy_kWh"))


def cumulative_users(sessions: DataFrame, start=None, end=None) -> DataFrame:
    """Running count of distinct users by start time; the date filter comes after.

    Each user's first session is one extra "first" row (a grouped minimum, no
    per-user window, so a heavy user is combined map-side); the running sum of
    the first-flags over (time, user, first-before-others) gives every session
    row the number of users seen so far.  The rows are dealt once, and both
    the firsts and the rows come from that exchange.
    """
    rows = (sessions.filter(F.col("userId").isNotNull()).select("dcosId", "startChargeTime", "userId")
            .repartition(time_slice("startChargeTime")))
    firsts = (rows.groupBy("userId").agg(F.min_by("dcosId", "startChargeTime").alias("dcosId"),
                                         F.min("startChargeTime").alias("startChargeTime")))
    events = (rows.withColumn("_first", F.lit(0))
              .unionByName(firsts.withColumn("_first", F.lit(1))))
    order = [F.col("startChargeTime"), F.col("userId"), F.col("_first").desc(), F.col("dcosId")]
    run = global_running_sum(events, order,
                             F.col("_first").cast("long"), "cumulative_users", time_slice("startChargeTime"))
    out = run.filter(F.col("_first") == 0).drop("_first")
    return between_dates(out, "startChargeTime", start, end)


def top_vehicle_models(sessions: DataFrame, n: int = 20, start=None, end=None) -> DataFrame:
    """Top-n vehicle models by energy; null models are not a group."""
    s = between_dates(sessions, "startChargeTime", start, end).filter(F.col("vehicle_model").isNotNull())
    agg = s.groupBy("vehicle_model").agg(F.coalesce(F.sum("cumEnergy_Wh"), F.lit(0.0)).alias("cumEnergy_Wh"))
    return (agg.orderBy(F.col("cumEnergy_Wh").desc(), F.col("vehicle_model")).limit(n)
               .withColumn("cumEnergy_kWh", F.bround(F.col("cumEnergy_Wh") / 1000, 1)))


def choice_by_price(sessions: DataFrame) -> DataFrame:
    """Count per (scheduled price, regular price, choice); rows with a null key dropped."""
    keys = ["sch_centsPerHr", "reg_centsPerHr", "choice"]
    return (sessions.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("counts")))


def user_profile(subset: DataFrame) -> DataFrame:
    """Per user: sessions, mean hours, usual part of day, kWh, preferred choice and share.

    One scan: a single ``GROUPING SETS`` aggregation -- (user), (user, part of
    day), (user, choice) -- partial-aggregated map-side, so a heavy user costs
    a few partial rows per task.  The winners are then picked by windows over
    that small result (a few rows per user), with no join and no string
    aggregation buffer.  Ties of both modes go to the smallest value (the
    reference's ``mode()`` rule; its ``value_counts`` tie order is not
    reproducible).
    """
    base = (subset.filter(F.col("userId").isNotNull())
            .withColumn("_part", part_of_day(F.hour("connectTime"))))
    g = (base.groupingSets([["userId"], ["userId", "_part"], ["userId", "choice"]], "userId", "_part", "choice")
             .agg(F.count("*").alias("_n"), F.avg("DurationHrs").alias("_h"),
                  F.sum("cumEnergy_Wh").alias("_wh"), F.grouping_id().alias("_gid")))
    # grouping_id bits: _part = 2, choice = 1 (set bit = rolled up)
    is_user, is_part, is_choice = F.col("_gid") == 3, F.col("_gid") == 1, F.col("_gid") == 2
    label = F.when(is_part, F.col("_part")).when(is_choice, F.col("choice"))
    per_user = Window.partitionBy("userId")
    ranked = (g.filter(is_user | is_part | (is_choice & F.col("choice").isNotNull()))
               .withColumn("_label", label)
               .withColumn("_rk", F.row_number().over(
                   Window.partitionBy("userId", "_gid").orderBy(F.col("_n").desc(), F.col("_label"))))
               .withColumn("_best_part", F.max(F.when(is_part & (F.col("_rk") == 1), F.col("_label"))).over(per_user))
               .withColumn("_best_choice", F.max(F.when(is_choice & (F.col("_rk") == 1), F.col("_label"))).over(per_user))
               .withColumn("_best_n", F.max(F.when(is_choice & (F.col("_rk") == 1), F.col("_n"))).over(per_user)))
    return ranked.filter(is_user).select(
        "userId",
        F.col("_n").alias("num_sessions"),
        F.bround(F.col("_h"), 2).alias("average_duration"),
        F.col("_best_part").alias("freq_connect_time"),
        (F.coalesce(F.col("_wh"), F.lit(0.0)) / 1000).alias("total_nrg_consumed"),
        F.col("_best_choice").alias("pref_charging_choice"),
        (F.coalesce(F.col("_best_n"), F.lit(0)) / F.col("_n")).alias("pref_charging_choice_percent"))


def histogram(table: DataFrame, quantity: str, group_col: F.Column, group_name: str,
                bins: int = 10) -> DataFrame:
    """Percent histogram of ``quantity`` per group, ``bins`` equal-width bins.

    Bin edges come from each group's min / max: grouped figures, one row per
    group, joined back, so no group's rows meet in one task.  The maximum falls
    into the last bin.
    """
    t = table.select(group_col.alias(group_name), F.col(quantity).alias("_x")).filter(F.col("_x").isNotNull())
    stats = t.groupBy(group_name).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
                                      F.count(F.lit(1)).alias("_n"))
    t = t.join(stats, group_name)
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") > F.col("_lo"),
               F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins),
                       F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    binned = t.groupBy(group_name, b.alias("bin"), "_lo", "_hi", "_n").agg(F.count("*").alias("count"))
    return binned.select(
        group_name, "bin",
        (F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
        F.when(F.col("bin") == bins - 1, F.col("_hi")).otherwise(F.col("_lo") + (F.col("bin") + 1) * width)
         .alias("bin_hi"),
        "count",
        (F.col("count") * 100.0 / F.col("_n")).alias("percent"))


def histogram_by_weekday(daily: DataFrame, quantity: str, bins: int = 10) -> DataFrame:
    return histogram(daily, quantity, F.col("day"), "day", bins)


def histogram_by_hour(hourly: DataFrame, quantity: str, bins: int = 10) -> DataFrame:
    return histogram(hourly, quantity, F.hour("time"), "hour", bins)


def yesterday_overlay(d5: DataFrame, as_of, quantity: str = "avg_power_demand_kW", by=()) -> DataFrame:
    """yesterday's curve moved forward a day, beside today's.

    Yesterday runs from its midnight to today's midnight, both included (the
    reference's bounds).  One pass: each 5-minute row in [yesterday, tomorrow]
    becomes a "yesterday" point one day later and / or a "today" point, then
    one ``groupBy(time)`` -- no join, no second read of the table.
    """
    today0 = day_start(as_ntz(as_of))
    yest0 = F.timestamp_add("DAY", F.lit(-1), today0)
    tomorrow0 = F.timestamp_add("DAY", F.lit(1), today0)
    t, v = F.col("time"), F.col(quantity)
    none = F.lit(None).cast("double")
    points = F.array_compact(F.array(
        F.when(t <= today0, F.struct(F.timestamp_add("DAY", F.lit(1), t).alias("t"), v.alias("y"), none.alias("x"))),
        F.when(t >= today0, F.struct(t.alias("t"), none.alias("y"), v.alias("x")))))
    rows = (d5.filter((t >= yest0) & (t <= tomorrow0))
              .select(*by, F.explode(points).alias("_p"))
              .select(*by, F.col("_p.t").alias("time"), F.col("_p.y").alias("_y"), F.col("_p.x").alias("_t")))
    return rows.groupBy(*by, "time").agg(F.max("_y").alias("yesterday_" + quantity),
                                         F.max("_t").alias("today_" + quantity))
