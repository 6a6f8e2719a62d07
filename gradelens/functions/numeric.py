"""Numeric helpers: safe coercion (P16), exact rounding of count ratios, rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelens.spec import OutcomeSpec


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scaled_round(num, den, digits: int) -> Column:
    """``round(num / den * 10^digits)`` half to even, as an exact long.

    Rounding a double is engine dependent at decimal ties (1.005 has no exact
    binary form); for integer counts the ratio is rounded exactly in integer
    arithmetic — half to even, as Python's ``round`` does on exact ties — so
    every engine returns the same value.  ``den <= 0`` → 0.
    """
    num, den = _c(num).cast("long"), _c(den).cast("long")
    a = F.abs(num) * F.lit(10 ** digits)
    r = F.try_mod(a, den)  # NULL for den = 0 (then the result is 0)
    # (a - r) is a multiple of den: the quotient is exact below 2^53
    whole = F.try_divide(a - r, den).cast("long")
    up = (r * 2 > den) | ((r * 2 == den) & (F.pmod(whole, F.lit(2)) == 1))
    rounded = whole + F.when(up, F.lit(1)).otherwise(F.lit(0))
    signed = F.when(num < 0, -rounded).otherwise(rounded)
    return F.when(den > 0, signed).otherwise(F.lit(0).cast("long"))


def round_ratio(num, den, digits: int) -> Column:
    """``round(num / den, digits)`` for integers, identical in every engine."""
    return scaled_round(num, den, digits).cast("double") / F.lit(float(10 ** digits))


def pct_rounded(num, den, digits: int) -> Column:
    """``round(100 * num / den, digits)`` exactly, 0.0 when ``den`` is 0."""
    return round_ratio(_c(num).cast("long") * F.lit(100), den, digits)


def ratio(num, den) -> Column:
    """``num / den`` as double, 0.0 when ``den`` is 0 (rates of counts)."""
    return F.coalesce(F.try_divide(_c(num).cast("double"), _c(den).cast("double")), F.lit(0.0))


def with_rates(df, spec: OutcomeSpec, total: str = "total"):
    """Add ``<level>_rate`` for every level above the base, and ``risk``."""
    cols = []
    for name in reversed(spec.names[1:]):
        cols.append(ratio(F.col(name), F.col(total)).alias(f"{name}_rate"))
    cols.append(ratio(spec.risk_numerator(), F.col(total)).alias("risk"))
    return df.select("*", *cols)


def sqrt_scaled(*cols: str, suffix: str = "_disp") -> list[Column]:
    """Square-root scaled counts (``sqrt(c)`` as ``c<suffix>``) for area-true bars."""
    return [F.sqrt(F.col(c).cast("double")).alias(f"{c}{suffix}") for c in cols]


def _trim_zeros(text: Column) -> Column:
    # "12.50" -> "12.5", "12.0" -> "12"; integers keep their zeros
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def pct_text(col) -> Column:
    """Adaptive percent text: one decimal from 1, two from 0.1, three below,
    ``<0.001`` for a non-zero value that rounds to 0, ``0`` for zero,
    negative or non-finite values; trailing zeros dropped."""
    v = _c(col).cast("double")
    def fixed(d):
        return _trim_zeros(F.format_string(f"%.{d}f", F.round(v, d)))
    small = F.when(F.round(v, 3) == 0, F.lit("<0.001")).otherwise(fixed(3))
    bad = v.isNull() | F.isnan(v) | (v <= 0) | (v == float("inf"))
    return F.when(bad, F.lit("0")).when(v >= 1, fixed(1)).when(v >= 0.1, fixed(2)).otherwise(small)


def rate_band(a, b):
    """Row-wise min / max of two rates (P29 band)."""
    return F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b))
