"""Session cleaning.

pandas rules kept on purpose (SURVEY 1.4): a zero test keeps nulls (N1);
``x / 0`` becomes null instead of inf (N6); overstay is floored at 0 and a
missing deadline counts as 0 (N8); ``Overstay_h`` drops whole days like
``Timedelta.seconds`` (N7) while ``Overstay_total_h`` does not; a ``Duration``
text without a day count is dropped instead of raising (N17).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadcurve.functions.timecols import as_ntz, day_start
from loadcurve.schemas import PERSONAL_COLUMNS

SUBSET_COLUMNS = ["connectTime", "userId", "cumEnergy_Wh", "DurationHrs", "choice"]

# Fixed value: the day count inside the text form of a duration.
DAYS_PATTERN = r"(\d{1,2}) days"


def _not_zero(col: str):
    return ~F.col(col).eqNullSafe(F.lit(0.0))


def _day_count(rule: str):
    if rule == "regex":
        return F.regexp_extract(F.col("Duration"), DAYS_PATTERN, 1).try_cast("int")
    if rule == "first_char":  # the "today" path reads only the first character
        return F.substring(F.col("Duration"), 1, 1).try_cast("int")
    raise ValueError(f"unknown day rule {rule!r}")


def keep_condition(max_hours: float = 24.0, max_days: int = 2, day_rule: str = "regex"):
    """The rows a cleaning path keeps, as one boolean Column over raw columns."""
    return (_not_zero("peakPower_W") & _not_zero("cumEnergy_Wh")
            & (F.col("DurationHrs").cast("double") <= F.lit(float(max_hours)))
            & (_day_count(day_rule) <= F.lit(max_days)))


def with_helpers(raw: DataFrame) -> DataFrame:
    """Casts and helper columns of a cleaned session (no row is removed here)."""
    df = raw.drop(*[c for c in PERSONAL_COLUMNS if c in raw.columns])
    overstay_us = F.greatest(F.timestamp_diff("MICROSECOND", F.col("Deadline"), F.col("lastUpdate")), F.lit(0))
    return (df.withColumn("cumEnergy_Wh", F.col("cumEnergy_Wh").cast("double"))
              .withColumn("peakPower_W", F.col("peakPower_W").cast("double"))
              .withColumn("finishChargeTime", F.col("lastUpdate"))
              .withColumn("true_peakPower_W",
                          F.bround(F.try_divide(F.col("cumEnergy_Wh"), F.col("DurationHrs").cast("double")), 0))
              .withColumn("Overstay_s", F.floor(overstay_us / 1_000_000).cast("long"))
              .withColumn("Overstay_h", F.pmod(F.col("Overstay_s"), F.lit(86400)) / 3600.0)
              .withColumn("Overstay_total_h", overstay_us / 3.6e9))


def clean_sessions(raw: DataFrame, max_hours: float = 24.0, max_days: int = 2,
                   day_rule: str = "regex") -> DataFrame:
    """Raw sessions -> ``sessions`` (the reference's ``raw_data``)."""
    return with_helpers(raw.filter(keep_condition(max_hours, max_days, day_rule)))


def newest_reports(reports: DataFrame, *then) -> DataFrame:
    """One row per session: of several reports the newest, then by ``then``, then by a hash of the row.

    Rows without an id are sessions of their own and all stay: each gets a key
    of its own, so ``row_number() = 1`` is a ``WindowGroupLimit`` and a task
    hands on one row per session.
    """
    own = F.when(F.col("dcosId").isNull(), F.monotonically_increasing_id())
    w = Window.partitionBy("dcosId", "_own").orderBy(F.col("lastUpdate").desc(), *then, F.xxhash64(*reports.columns))
    return (reports.withColumn("_own", own).withColumn("_rk", F.row_number().over(w))
            .filter(F.col("_rk") == 1).drop("_rk", "_own"))


def today_condition(as_of, max_hours: float = 24.0, max_days: int = 1):
    """The "today" path: first-character day rule, finished since midnight of ``as_of``."""
    return (keep_condition(max_hours, max_days, "first_char")
            & (F.col("lastUpdate") >= day_start(as_ntz(as_of))))


def clean_todays_sessions(raw: DataFrame, as_of, max_hours: float = 24.0, max_days: int = 1) -> DataFrame:
    return with_helpers(raw.filter(today_condition(as_of, max_hours, max_days)))


def session_subset(sessions: DataFrame, columns=None) -> DataFrame:
    return sessions.select(*(columns or SUBSET_COLUMNS))
