"""Column helpers (pure ``Column -> Column`` expressions, JVM side)."""

from loadcurve.functions.timecols import (  # noqa: F401
    as_ntz, day_start, epoch_micros, floor_time, from_epoch_micros, hour_start,
    month_end, month_name, round_time, slot_index, slot_time, weekday_name,
)
from loadcurve.functions.scalars import (  # noqa: F401
    change_direction, part_of_day, pct_change, state_text,
)
