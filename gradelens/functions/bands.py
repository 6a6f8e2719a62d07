"""Band and flag expressions."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Part-of-day bands (both ends of the night share one label).
HOUR_BANDS = (
    (6, 11, "Morning (6-11)"),
    (12, 16, "Afternoon (12-16)"),
    (17, 20, "Evening (17-20)"),
)
NIGHT = "Night (0-5)"
PART_OF_DAY = ("Morning (6-11)", "Afternoon (12-16)", "Evening (17-20)", "Night (0-5)")

# Vehicle-age style bands, upper bounds inclusive.
AGE_BANDS = ((2, "0-2 yrs"), (5, "3-5 yrs"), (10, "6-10 yrs"), (15, "11-15 yrs"))
AGE_TOP = "Over 15 yrs"

WEEKEND_DAYS = ("Saturday", "Sunday")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number_band(col, bands: Sequence[tuple] = AGE_BANDS, top: str = AGE_TOP,
                unknown: str = "Unknown") -> Column:
    """Negative → unknown, ordered upper-bound bands, else ``top``, NULL and text that is no number → unknown."""
    c = _c(col).try_cast("double")
    expr = F.when(c < 0, F.lit(unknown))
    for hi, label in bands:
        expr = expr.when(c <= hi, F.lit(label))
    return expr.when(c.isNotNull(), F.lit(top)).otherwise(F.lit(unknown))


def hour_band(hour, bands: Sequence[tuple] = HOUR_BANDS, other: str = NIGHT) -> Column:
    """Closed hour ranges; anything else (including NULL) is the night band."""
    h = _c(hour)
    expr = None
    for lo, hi, label in bands:
        cond = h.between(lo, hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(other))


def hour_or_default(hour, default: int = 12) -> Column:
    """P25: hour with a default when missing (the band uses the raw hour)."""
    return F.coalesce(_c(hour), F.lit(default)).cast("short")


def hour_of_time_text(text) -> Column:
    """Hour of an ``H:m:s`` text; NULL when it does not parse."""
    return F.hour(F.try_to_timestamp(_c(text).cast("string"), F.lit("H:m:s")))


def weekend_flag(day, days: Sequence[str] = WEEKEND_DAYS) -> Column:
    """P21 from a weekday name."""
    return _c(day).isin(list(days))


def weekend_from_ts(ts) -> Column:
    """P21 from a timestamp: Sunday = 1, Saturday = 7."""
    return F.dayofweek(_c(ts)).isin(1, 7)


def ordinal(col, levels: Sequence[str]) -> Column:
    """Position of ``col`` in ``levels``; NULL when absent."""
    expr = F.lit(None).cast("short")
    for i in reversed(range(len(levels))):
        expr = F.when(_c(col) == F.lit(levels[i]), F.lit(i).cast("short")).otherwise(expr)
    return expr
