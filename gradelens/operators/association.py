"""Contingency counts and Cramér's V for many fields in one scan.

The fields are cast to text and unpivoted into ``(field, value, outcome)``
right after the scan; the partial aggregate runs in the same stage, so the
shuffle carries at most one row per (field, value) per input partition and
the table is read once whatever the number of fields.

Cramér's V per field, with ``L`` listed levels, ``n`` in-level rows:
``chi2 = sum over cells with expected > 0 of (o - e)^2 / e``,
``e = row_total * level_total / n``, ``k = min(#values, L)``,
``V = min(1, sqrt(chi2 / (n (k - 1))))``; ``V = 0`` when ``n = 0``, fewer
than two values, or ``k = 1``.  ``#values`` counts every observed value of
the field (NULL included), also values whose rows have no listed outcome.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelens.functions.predicates import Selection, require_columns, where
from gradelens.spec import OutcomeSpec, count_when


def _long(df: DataFrame, fields: Sequence[str], spec: OutcomeSpec,
          selection: Selection | Mapping | None) -> DataFrame:
    if not fields:
        raise ValueError("need at least one field")
    require_columns(df, list(fields) + [spec.column])
    src = where(df, selection).select(
        spec.col.alias("_outcome"), *[F.col(f).cast("string").alias(f) for f in fields])
    return src.unpivot(["_outcome"], list(fields), "field", "value")


def contingency(df: DataFrame, fields: Sequence[str], spec: OutcomeSpec,
                selection: Selection | Mapping | None = None) -> DataFrame:
    """A4: ``(field, value, outcome, n)`` for every field in one pass."""
    return (_long(df, fields, spec, selection)
            .groupBy("field", "value", F.col("_outcome").alias("outcome"))
            .agg(F.count(F.lit(1)).alias("n")))


def cramers_v(df: DataFrame, fields: Sequence[str], spec: OutcomeSpec,
              selection: Selection | Mapping | None = None, digits: int = 4) -> DataFrame:
    """A5 + T8: ``(field, v)`` sorted by ``v`` descending; ties keep the given field order.

    Over the cells with ``e > 0`` the observed and expected counts both sum
    to ``n``, so ``chi2 = n * sum_j S_j / t_j - n`` with level totals ``t_j``
    and ``S_j = sum over values of o_vj^2 / row_total_v``.  Every term is a
    per-field sum of per-cell values: the cells aggregate feeds one more
    aggregate by field (a few rows per field), with no join back and no
    window over a field's values, whatever the field's cardinality.
    """
    L = len(spec.levels)
    cells = (_long(df, fields, spec, selection)
             .groupBy("field", "value")
             .agg(*[count_when(F.col("_outcome") == F.lit(lv)).alias(f"c{i}")
                    for i, lv in enumerate(spec.levels)]))
    rt = sum((F.col(f"c{i}") for i in range(1, L)), F.col("c0")).cast("double")
    per_field = cells.groupBy("field").agg(
        F.count(F.lit(1)).alias("r"),
        *[F.sum(f"c{i}").alias(f"t{i}") for i in range(L)],
        *[F.sum(F.when(rt > 0, F.col(f"c{i}").cast("double") * F.col(f"c{i}").cast("double") / rt))
           .alias(f"s{i}") for i in range(L)])
    n = sum((F.col(f"t{i}") for i in range(1, L)), F.col("t0"))
    ratio_sum = sum((F.coalesce(F.try_divide(F.col(f"s{i}"), F.col(f"t{i}").cast("double")), F.lit(0.0))
                     for i in range(1, L)),
                    F.coalesce(F.try_divide(F.col("s0"), F.col("t0").cast("double")), F.lit(0.0)))
    chi2 = F.greatest(n.cast("double") * ratio_sum - n.cast("double"), F.lit(0.0))
    k = F.least(F.col("r"), F.lit(L))
    denom = n.cast("double") * (k - 1).cast("double")
    v = F.when((n == 0) | (F.col("r") < 2) | (denom <= 0), F.lit(0.0)) \
         .otherwise(F.least(F.lit(1.0), F.sqrt(F.try_divide(chi2, denom))))
    # ties keep the order the fields were given in
    given = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field"))
    return per_field.select("field", F.round(v, digits).alias("v")) \
                    .orderBy(F.desc("v"), given)
