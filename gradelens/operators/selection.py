"""Selections against another table (J7) and sorted distinct values."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelens.functions.predicates import typed_values


def surviving(values: Mapping[str, Sequence], other: DataFrame) -> DataFrame:
    """The ``(field, value)`` pairs of a selection that occur in ``other``.

    One scan of ``other``: rows are filtered by the OR of the per-field
    ``IN`` lists (pushed to the reader), each row emits the pairs it matches,
    and a distinct over those pairs — bounded by the selection size — gives
    the survivors.  Fields ``other`` lacks do not survive.
    """
    fields = [f for f in values if f in other.columns]
    if not fields:
        return other.sparkSession.createDataFrame([], "field string, value string")
    tests = {f: F.col(f).isin(typed_values(other, f, values[f])) for f in fields}
    rows = other.filter(reduce(lambda a, b: a | b, tests.values()))
    pairs = F.array(*[F.when(tests[f], F.struct(F.lit(f).alias("field"),
                                                 F.col(f).cast("string").alias("value")))
                      for f in fields])
    return (rows.select(F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("p"))
                .select("p.field", "p.value").distinct())


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """The distinct values of ``col`` in ascending order, NULL last."""
    return df.select(col).distinct().orderBy(F.asc_nulls_last(col))
