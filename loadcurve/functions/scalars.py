"""Small scalar rules of the dashboard cards, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's labels and cut points):
# part of day by connect hour: 6..10 morning, 11..16 afternoon,
# 17..22 evening, anything else night.
PART_OF_DAY_LABELS = ("Morning! 🐦", "Afternoon! ☀️", "Evening! 🌙", "Really late at night! 🦉")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pct_change(after, before) -> Column:
    """Percent change; both zero -> 0, before zero -> 100 (null counts as zero)."""
    a, b = F.coalesce(_c(after), F.lit(0.0)), F.coalesce(_c(before), F.lit(0.0))
    return (F.when((a == 0) & (b == 0), F.lit(0.0))
             .when(b == 0, F.lit(100.0))
             .otherwise((a - b) * 100.0 / b))


def change_direction(change) -> Column:
    c = _c(change)
    return F.when(c > 0, "up").when(c < 0, "down").otherwise("same")


def part_of_day(hour) -> Column:
    h = _c(hour)
    morning, afternoon, evening, night = PART_OF_DAY_LABELS
    return (F.when((h >= 6) & (h <= 10), morning)
             .when((h > 10) & (h <= 16), afternoon)
             .when((h > 16) & (h <= 22), evening)
             .otherwise(night))


def state_text(in_use) -> Column:
    return F.when(_c(in_use) == 1, "IN USE").otherwise("IDLE")
