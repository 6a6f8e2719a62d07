"""Filter predicates.

A selection is ``{field: [values]}`` plus optional closed ranges.  Values are
OR-ed inside a field and fields are AND-ed (P1).  Values are converted to the
column's own type on the driver so the predicate stays a plain ``IN`` on the
column and reaches the Parquet scan as a pushed filter; comparing the text
form of a non-string column would keep it out of ``PushedFilters``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Context, Decimal, InvalidOperation
from functools import reduce
from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INT_TEXT = re.compile(r"^-?\d+$")
_WIDE = Context(prec=80)


def _typed(value: Any, dtype: T.DataType):
    """Convert one selection value to ``dtype``; None when it can never match.

    Integral columns accept only the canonical integer text, matching the
    text-equality semantics of a selection sent as strings ('01' != '1').
    """
    if value is None:
        return None
    if isinstance(dtype, T.StringType):
        return str(value)
    if isinstance(dtype, T.BooleanType):
        if isinstance(value, bool):
            return value
        text = str(value).strip().lower()
        return {"true": True, "false": False}.get(text)
    if isinstance(value, bool):
        return None
    if isinstance(dtype, T.IntegralType):
        text = str(value)
        number = int(text) if _INT_TEXT.match(text) and str(int(text)) == text else None
        bits = _BITS[type(dtype)]
        return number if number is not None and -(1 << bits) <= number < 1 << bits else None
    if isinstance(dtype, T.DecimalType):
        return _decimal(value, dtype)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        # a double is equal in its text form: '1' is not the text of 1.0, '1.0' is
        try:
            number = float(value)
        except (TypeError, ValueError):
            return None
        return number if str(value) == str(number) else None
    return value


#: Bits of the integral types, without the sign.
_BITS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def _decimal(value: Any, dtype: T.DecimalType) -> Decimal | None:
    """The value as a decimal that the column can hold, or None (no number, more digits, more decimals than the column's text has)."""
    try:
        number = Decimal(str(value))
    except InvalidOperation:
        return None
    if not number.is_finite():
        return None
    exact = number.quantize(Decimal(1).scaleb(-dtype.scale), context=_WIDE) if number.adjusted() < 38 else None
    if exact is None or exact != number or exact.adjusted() >= dtype.precision - dtype.scale:
        return None
    # texts are compared as the column writes them, numbers by value
    return exact if isinstance(value, (int, float, Decimal)) or str(value) == format(exact, "f") else None


def typed_values(df: DataFrame, name: str, values: Sequence[Any]) -> list:
    dtype = df.schema[name].dataType
    out = []
    for v in values:
        t = _typed(v, dtype)
        if t is not None and t not in out:
            out.append(t)
    return out


def value_filter(df: DataFrame, name: str, values: Sequence[Any]) -> Column:
    """``name IN (values)`` with values typed to the column."""
    dtype = df.schema[name].dataType
    typed = typed_values(df, name, values)
    if not typed:
        return F.lit(False)
    if isinstance(dtype, T.DecimalType):
        return F.col(name).isin([F.lit(v).cast(dtype) for v in typed])
    if isinstance(dtype, (T.StringType, T.BooleanType, T.NumericType)):
        return F.col(name).isin(typed)
    # dates, timestamps: let Spark cast the literal (constant-folded)
    return F.col(name).isin([F.lit(str(v)).try_cast(dtype) for v in typed])


def validate_selection(df: DataFrame, values: Mapping[str, Any] | None) -> None:
    """Reject unknown fields, non-list and empty value lists."""
    if values is None:
        return
    if not isinstance(values, Mapping):
        raise ValueError("filters must be a mapping {field: [values]}")
    cols = set(df.columns)
    for name, vals in values.items():
        if name not in cols:
            raise ValueError(f"unknown filter field '{name}'")
        if not isinstance(vals, (list, tuple)) or not vals:
            raise ValueError(f"filter '{name}' needs a non-empty list")


def require_columns(df: DataFrame, names: Sequence[str], what: str = "field") -> None:
    cols = set(df.columns)
    for n in names:
        if n not in cols:
            raise ValueError(f"unknown {what} '{n}'")


@dataclass(frozen=True)
class Selection:
    """A cross-filter: value lists per field plus closed ranges per column.

    Ranges name a column and ``(lo, hi)``, either end optional; a range on a
    column the table does not have is ignored (P2).
    """

    values: Mapping[str, Sequence[Any]] = field(default_factory=dict)
    ranges: Mapping[str, tuple] = field(default_factory=dict)

    def clauses(self, df: DataFrame) -> list[tuple[str, Column]]:
        """(field, predicate) of every value list and range end."""
        validate_selection(df, self.values)
        out = [(f, value_filter(df, f, v)) for f, v in self.values.items()]
        cols = set(df.columns)
        for name, (lo, hi) in self.ranges.items():
            if name not in cols:
                continue
            if lo is not None:
                out.append((name, F.col(name) >= F.lit(lo)))
            if hi is not None:
                out.append((name, F.col(name) <= F.lit(hi)))
        return out

    def predicate(self, df: DataFrame) -> Column | None:
        clauses = [c for _, c in self.clauses(df)]
        return reduce(lambda a, b: a & b, clauses) if clauses else None

    def apply(self, df: DataFrame) -> DataFrame:
        pred = self.predicate(df)
        return df if pred is None else df.filter(pred)

    # -- facet self-exclusion (P3) -----------------------------------------
    def without(self, *fields: str, drop_ranges: Sequence[str] = ()) -> "Selection":
        """The selection a chart on ``fields`` uses: its own fields dropped."""
        vals = {k: v for k, v in self.values.items() if k not in fields}
        rng = {k: v for k, v in self.ranges.items() if k not in drop_ranges and k not in fields}
        return Selection(vals, rng)

    def cleared(self) -> "Selection":
        """A 'global' chart ignores every filter."""
        return Selection()


def where(df: DataFrame, selection: Selection | Mapping | None) -> DataFrame:
    if selection is None:
        return df
    if not isinstance(selection, Selection):
        selection = Selection(dict(selection))
    return selection.apply(df)


# -- named conditions (P5) ---------------------------------------------------
def starts_with(name: str, prefix: str) -> Column:
    return F.col(name).startswith(prefix)


def any_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds)
