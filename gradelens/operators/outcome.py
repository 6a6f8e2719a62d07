"""Outcome breakdowns.

Every operator filters first (so the predicate reaches the scan), then runs
one hash aggregate with conditional counts: a partial aggregate on each
input partition and a final one after a shuffle of at most one row per group
per partition.  A hot group costs one row per partition, not a third of the
data, so skew in the group key does not reach the shuffle.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelens.functions.numeric import pct_rounded, ratio, round_ratio, with_rates
from gradelens.functions.predicates import Selection, require_columns, where
from gradelens.spec import OutcomeSpec, count_when

MAX_LIMIT = 2000


def outcome_counts(df: DataFrame, keys: Sequence[Column | str], spec: OutcomeSpec) -> DataFrame:
    """``total`` and one count per level for each group of ``keys``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *spec.level_counts())


def breakdown_all(df: DataFrame, by: str, spec: OutcomeSpec,
                  selection: Selection | Mapping | None = None,
                  min_count: int = 0, as_text: bool = True) -> DataFrame:
    """A1 without the top-N cut: every group with rates and risk.

    The key is the text form of ``by`` (``as_text``), matching a breakdown that
    is keyed by strings whatever the column type; NULL stays a group.
    """
    require_columns(df, [by, spec.column])
    src = where(df, selection)
    key = F.col(by).cast("string") if as_text else F.col(by)
    agg = outcome_counts(src, [key.alias("key")], spec)
    if min_count > 0:
        agg = agg.filter(F.col("total") >= F.lit(min_count))  # T2 (HAVING)
    return with_rates(agg, spec)


def breakdown(df: DataFrame, by: str, spec: OutcomeSpec,
              selection: Selection | Mapping | None = None,
              min_count: int = 0, limit: int = 200, as_text: bool = True) -> DataFrame:
    """A1 + T1: groups by ``total`` descending, key ascending, first ``limit``.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each partition keeps
    its own top ``limit`` rows, so no full sort happens.
    """
    if limit < 1 or limit > MAX_LIMIT:
        raise ValueError(f"limit must be in 1..{MAX_LIMIT}")
    agg = breakdown_all(df, by, spec, selection, min_count, as_text)
    return agg.orderBy(F.desc("total"), F.asc_nulls_last("key")).limit(limit)


def matrix(df: DataFrame, x: str, y: str, spec: OutcomeSpec,
           selection: Selection | Mapping | None = None) -> DataFrame:
    """A3: two-way breakdown with total, top and second level counts."""
    require_columns(df, [x, y, spec.column])
    src = where(df, selection)
    return src.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(
        F.count(F.lit(1)).alias("total"),
        count_when(spec.is_level(len(spec.levels) - 1)).alias(spec.top),
        count_when(spec.is_level(len(spec.levels) - 2)).alias(spec.second),
    )


def peak(df: DataFrame, key: str, selection: Selection | Mapping | None = None) -> DataFrame:
    """The most frequent value of ``key`` (ties → smallest value)."""
    src = where(df, selection)
    per = src.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.max_by("k", F.struct(F.col("n"), -F.col("k"))).alias(f"peak_{key}"))


def kpis(df: DataFrame, spec: OutcomeSpec, measure: str, weekend: str, hour: str | None,
         selection: Selection | Mapping | None = None, digits: int = 2) -> DataFrame:
    """A2 in one scan: total, top / second level percent, mean of ``measure``,
    weekend percent, peak hour and the count of every level.

    The scan is aggregated by ``hour`` first (partial + final hash aggregate),
    then the per-hour rows — one per distinct hour — fold into one row, so the
    peak hour needs no second pass over the table.  Empty selection → zeros
    and a NULL peak.  ``measure`` must be integral so its mean rounds exactly.
    """
    cols = [spec.column, measure, weekend] + ([hour] if hour else [])
    require_columns(df, cols)
    src = where(df, selection)
    keys = [F.col(hour).alias("h")] if hour else []
    per = src.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(measure).cast("long")).alias("m_sum"),
        F.count(F.col(measure)).alias("m_cnt"),
        count_when(F.col(weekend)).alias("wk"),
        *spec.level_counts(),
    )
    aggs = [
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.sum("m_sum"), F.lit(0)).cast("long").alias("m_sum"),
        F.coalesce(F.sum("m_cnt"), F.lit(0)).cast("long").alias("m_cnt"),
        F.coalesce(F.sum("wk"), F.lit(0)).cast("long").alias("wk"),
    ] + [F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in spec.names]
    if hour:
        aggs.append(F.max_by("h", F.struct(F.col("n"), -F.col("h"))).alias("peak_hour"))
    one = per.agg(*aggs)
    out = [
        F.col("total"),
        pct_rounded(spec.top, "total", digits).alias(f"{spec.top}_pct"),
        pct_rounded(spec.second, "total", digits).alias(f"{spec.second}_pct"),
        round_ratio("m_sum", "m_cnt", digits).alias(f"avg_{measure}"),
        pct_rounded("wk", "total", digits).alias("weekend_pct"),
    ]
    if hour:
        out.append(F.col("peak_hour"))
    out += [F.col(n) for n in spec.names]
    return one.select(*out)


def condition_lift(df: DataFrame, spec: OutcomeSpec, conditions: Mapping[str, Column],
                   selection: Selection | Mapping | None = None, digits: int = 1) -> DataFrame:
    """Percent of non-base outcomes under each named condition vs baseline.

    One scan computes every conditional count; the single result row is then
    turned into one row per condition with ``inline``.
    """
    src = where(df, selection)
    severe = spec.not_base()
    aggs = [F.count(F.lit(1)).alias("base_n"), count_when(severe).alias("base_severe")]
    names = list(conditions)
    for i, name in enumerate(names):
        cond = conditions[name]
        aggs.append(count_when(cond).alias(f"n{i}"))
        aggs.append(count_when(cond & severe).alias(f"s{i}"))
    one = src.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("axis"),
                 F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("severe"))
        for i, name in enumerate(names)
    ])
    long = one.select("base_n", "base_severe", F.inline(rows))
    return long.select(
        "ordinal", "axis", "n", "severe",
        pct_rounded("severe", "n", digits).alias("value"),
        pct_rounded("base_severe", "base_n", digits).alias("baseline"),
    )


__all__ = ["breakdown", "breakdown_all", "matrix", "peak", "kpis", "condition_lift",
           "outcome_counts", "ratio"]
